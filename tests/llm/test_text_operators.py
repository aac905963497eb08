"""Language, quality, benchmark and token operators against plain re-computations."""

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from wayfare.llm import decontaminate, language, packing, quality, queries, token_files
from wayfare.llm.common import tuned
from wayfare.llm.simple8b import decode, encode
from wayfare.llm.tokens import encoded, vocabulary

TEXTS = [
    (1, "one two three one two three\none two three\n\n  \none two three"),
    (2, None),
    (3, ""),
    (4, "  \t\n "),
    (5, "é#* ünd $ % a&b|c <d>\rx\x0by"),
    (6, "a a a a"),
    (7, "a b c\na b c \na b c\n"),
    (7, "a b c\na b c \na b c\n"),
    (None, "word " * 3000),
]
SCHEMA = "doc_id long, text string, lang string, kept int"


@pytest.fixture(scope="module")
def docs(spark):
    return tuned(spark).createDataFrame([(i, t, None, 1) for i, t in TEXTS], SCHEMA)


def rows(duck, sql):
    return duck.execute(sql).fetchall()


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    threes = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if threes[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(hit))


def test_counts(spark, docs, duck, tiny):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    found = quality.quality_rules(docs, labels).collect()
    want = sorted(map(str, ((i, *plain_counts(t)) for i, t in TEXTS)))
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
                  for r in found) == want
    assert not any(r.kept for r in found)
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, tiny).collect()}
    for doc_id, text in rows(duck, "select doc_id, text from documents"):
        r, plain = got[doc_id], plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain
        assert r.base_failed == (plain[0] < 50 or 100 * plain[4] > 50 * plain[0])
        assert not (r.kept and r.base_failed)


def test_binomial_bound():
    for n, x, p in ((10, 2, 0.5), (50, 0, 0.02), (400, 3, 0.05)):
        exact = sum(math.comb(n, k) * p**k * (1 - p)**(n - k) for k in range(x + 1))
        assert quality.binomial_at_most(x, n, p) == pytest.approx(exact, rel=1e-9)
    # 0 of 2,000 good documents above 3 shows less than 1 % at this level, 0 of 100 does not
    assert quality.tightest([2000, 500, 40, 0, 0], 2000, 0.01, 1e-4) == 3
    assert quality.tightest([100, 0], 100, 0.01, 1e-4) is None


def test_cutoffs_limit_false_rejections(spark):
    tuned(spark)
    rng = np.random.default_rng(3)
    # every tenth document is poor and full of symbols
    data = [(i, "x", 100, 1000, int(400 if i % 10 == 0 else rng.integers(0, 5)), 5, 0, 0) for i in range(6000)]
    counts = spark.createDataFrame(
        data, "doc_id long, lang string, " + ", ".join(f"{n} long" for n in quality.COUNTS))
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(6000)], "doc_id long, quality int")
    limits = quality.cutoffs(counts, labels, "doc_id", "lang", share=0.02)
    judged = quality.judged(counts, limits, "lang").collect()
    good = [r.kept for r in judged if r.doc_id % 10]
    assert sum(good) >= 0.98 * len(good)
    assert not any(r.kept for r in judged if r.doc_id % 10 == 0)


def test_kept_with_a_few_hundred_labels_per_stratum(spark):
    """Four strata, the smallest too small for a test; the whole sequence by brute force."""
    tuned(spark)
    rng = np.random.default_rng(5)
    data = []
    for lang, n in (("a", 420), ("b", 380), (None, 700), ("few", 150)):
        for i in range(n):
            bad = i % 10 == 0
            data.append((len(data), lang, 1000, int(rng.integers(4000, 6000)),
                         int(rng.integers(300, 900) if bad else rng.integers(0, 60)), 100,
                         int(rng.integers(20, 60) if bad else rng.integers(0, 6)), int(rng.integers(0, 90))))
    names = "doc_id long, lang string, " + ", ".join(f"{n} long" for n in quality.COUNTS)
    counts = spark.createDataFrame(data, names)
    labels = spark.createDataFrame([(r[0], int((r[4] < 100))) for r in data if r[0] % 20 != 5],
                                   "doc_id long, quality int")
    draws = {r.doc_id for r in counts.filter(f"pmod(xxhash64(doc_id), {quality.DRAWING}) = 0").collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    values = {r[0]: (min(200, r[4] * 1000 // r[3]), min(200, r[6] * 100 // r[5]), min(200, r[7] * 100 // r[2]),
                     min(200, r[3] * 10 // r[2])) for r in data}
    def steps(drawn):
        """The step at which a value is rejected, from the values of those that draw."""
        top, middle = max(drawn), sorted(drawn)[(len(drawn) - 1) // 2]
        return [16 * (v - top) // (top - middle + 1) if v > top else -sum(d >= v for d in drawn)
                for v in range(201)]

    want = {}
    for lang in ("a", "b", None, "few"):
        ids = [r[0] for r in data if r[1] == lang]
        good = [i for i in ids if known.get(i) == 1]
        held = [i for i in good if i not in draws]
        at = [steps([values[i][f] for i in good if i in draws]) for f in range(4)]
        step = {i: max(at[f][values[i][f]] for f in range(4)) for i in ids}
        chosen = 10**6
        for last in range(16 * 201, -len(good), -1):
            x, n = sum(step[i] >= last for i in held), len(held)
            if sum(math.comb(n, k) * 0.02**k * 0.98**(n - k) for k in range(x + 1)) > 0.05 / 4:
                break
            if any(step[i] == last - 1 for i in held):  # steps that reject no more are not taken
                chosen = last
        want |= {i: step[i] < chosen for i in ids}
    limits = quality.cutoffs(counts, labels, "doc_id", "lang")
    got = {r.doc_id: r.kept for r in quality.judged(counts, limits, "lang").collect()}
    assert got == want
    large = [(r, got[r[0]]) for r in data if r[1] != "few"]
    assert not any(kept for r, kept in large if r[4] >= 300)
    assert sum(kept for r, kept in large if r[4] < 300) >= 0.98 * sum(r[4] < 300 for r, _ in large)
    assert all(got[r[0]] for r in data if r[1] == "few")


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_rules(none, labels).count() == 0
    assert language.identify(none, language.parsers(none)).count() == 0
    items = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(docs, items).count() == len(TEXTS)
    assert packing.pack(none, vocabulary()).count() == 0


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(text, items, size=10):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        k = min(size, len(own))
        keys = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i:i + k]) in keys:
                hit |= set(range(i, i + k))
                names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_decontamination_query(spark, tiny, duck):
    items = rows(duck, "select item_id, text from benchmark")
    got = {r.doc_id: r for r in queries.op10_decontamination(spark, tiny).collect()}
    some = 0
    for doc_id, text in rows(duck, "select doc_id, text from documents"):
        r, plain = got[doc_id], plain_hits(text, items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == plain
        assert r.contaminated == (plain[1] > 0)
        some += r.contaminated
    assert some


def test_decontamination_cases(spark):
    tuned(spark)
    items = [("b", "One two, THREE four five six seven eight nine ten eleven"), ("a", "Élan vital"), ("a", "Élan vital"),
             (None, "zig zag"), ("c", None), ("d", "...")]
    texts = [(1, "x one TWO three-four five six seven eight nine ten y " + "pad " * 30), (2, "élan vital Élan vital!"),
             (3, None), (4, "zig zag zig and more words here to keep"), (5, "nothing")]
    docs = spark.createDataFrame([(i, t, i) for i, t in texts], "doc_id long, text string, found int")
    table = spark.createDataFrame(items, "item_id string, text string")
    for limit in (1 << 20, 8):  # one scan, and several
        found = decontaminate.found_windows(docs.drop("found"), table, limit=limit)
        got = {r.doc_id: r.found for r in found.collect()}
        assert got[1]["items"] == ["b"] and got[1]["from_word"] == [1] and got[1]["to_word"] == [11]
        # a capital É is another byte sequence than é
        assert got[2]["items"] == ["a"] and got[2]["from_word"] == [2]
        assert got[4]["items"] == [] and got[4]["to_word"] == [2]
        assert got[3]["n_words"] == 0 and got[5]["from_word"] == []
    cleaned = {r.doc_id: r for r in decontaminate.decontaminate(docs, table).collect()}
    assert set(cleaned) == {1, 3, 4, 5} and cleaned[1].found == 1
    assert cleaned[1].text.startswith("x  y pad") and cleaned[3].text is None and cleaned[5].text == "nothing"


def test_window_set_is_small():
    """Arrays, not objects: bytes per byte of item text, for usual words and for the shortest ones."""
    rng = np.random.default_rng(5)
    usual = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60_000)]
    for text, times in ((" ".join(usual), 6), ("a b " * 60_000, 14)):
        known = decontaminate.WindowSet([("x", text)])
        assert len(pickle.dumps(known)) < times * len(text) + 11 * (1 << 20)
    known = decontaminate.WindowSet([(str(i), "one two three four five six seven eight nine ten " + "z " * i)
                                     for i in range(6000)] + [(None, "lone")])
    text = np.frombuffer(b"zero one two three four five six seven eight nine ten lone", np.uint8)
    found = list(known.hits(text, decontaminate.scan(text, np.array([0, len(text)]), decontaminate.ALPHANUMERIC)))
    assert [(at, k, len(names)) for at, k, names in found] == [(11, 1, 0), (1, 10, 6000)]


def test_decontamination_against_sql(spark, tiny, duck):
    assert oracle.difference(queries.op10_decontamination(spark, tiny), duck,
                             queries.ORACLES["op10_decontamination"]) is None


def test_language_held_out(spark, tiny, duck):
    got = {r.doc_id: r for r in queries.op1_language_id(spark, tiny).collect()}
    right = total = 0
    for doc_id, text, lang in rows(duck, "select doc_id, text, lang from documents"):
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out and lang is not None:
            right, total = right + (r.lang_pred == lang), total + 1
    assert right >= 0.95 * total > 0


def test_cross_parsing():
    """The table's phrase counts against a plain greedy parse, over several blocks."""
    samples = {"x": b"abracadabra abc", "y": b"zzyzx road"}
    trained = [{"lang": n, "size": len(t), "moves": np.array(
        [(s, c, to) for s, moves in enumerate(language.automaton(t)) for c, to in moves.items()], np.int32).tobytes()}
        for n, t in samples.items()]
    texts = [b"abra zzy", b"", b"q" * 5, b"ABC road" * 700, b"r"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    borders = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = language.Parser(trained).phrases(data, borders)

    def phrases(text, sample):
        count = 0
        for at in range(0, len(text), language.BLOCK):
            block, i = text[at:at + language.BLOCK].lower(), 0
            while i < len(block):
                j = i + 1
                while j <= len(block) and block[i:j] in sample:
                    j += 1
                i, count = max(j - 1, i + 1), count + 1
        return count

    for i, name in enumerate(samples):
        assert found[i].tolist() == [phrases(t, samples[name]) for t in texts]


def test_sample_shares():
    assert language.shares([5, 100, 1, 100], 50) == [5, 22, 1, 22]
    assert language.shares([], 10) == [] and language.shares([3, 2], 10) == [3, 2]
    text = bytes(i % 251 for i in range(100_000))
    for limit in (1, 150, 1000, 24_000, 99_999):
        cut = language.stretches(text, limit)
        assert limit - language.STRETCHES < len(cut) < limit + language.STRETCHES
    assert language.stretches(text, 0) == b"" and language.stretches(text, 100_000) == text


def test_long_training_text(spark):
    """Stretches of the whole of a long text are learnt, and it fills the sample alone."""
    tuned(spark)
    text = "".join(f"{i:06d} é " for i in range(40_000))
    docs = spark.createDataFrame([(text, "a"), ("short", "b"), ("", "c"), ("short", None), (None, "d")],
                                 "text string, lang string")
    cut = docs.limit(1).select(language._stretched(F.col("text")).alias("t")).first()["t"]
    assert bytes(cut) == language.stretches(text.encode(), language.SAMPLE_BYTES)
    got = {r.lang: r for r in language.parsers(docs).collect()}
    assert set(got) == {"a", "b"} and bytes(got["b"]["sample"]) == b"short"
    raw = text.encode()
    assert got["a"]["size"] == language.SAMPLE_BYTES + language.STRETCHES - 1
    assert raw.find(bytes(cut)[-1500:]) > 0.9 * len(raw) and 0 < raw.find(bytes(cut)[:1500]) < 0.1 * len(raw)


def plain_phrases(text, sample):
    low = bytes(language._FOLD[np.frombuffer(text, np.uint8)])
    count = 0
    for at in range(0, len(low), language.BLOCK):
        block, i = low[at:at + language.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j <= len(block) and block[i:j] in sample:
                j += 1
            i, count = max(j - 1, i + 1), count + 1
    return count


@pytest.mark.parametrize("limit", [language.TABLE_BYTES, 60_000])
def test_language_by_brute_force(spark, tiny, limit):
    """Labels and scores of three hundred languages against plain parses; one scan, and many."""
    tuned(spark)
    rng = np.random.default_rng(2)
    train = [(i, " ".join("".join(rng.choice(list("abcdeéß日"), 3)) for _ in range(8)), f"l{i:03d}")
             for i in range(299)] + [(299, "l000 twin", "twin"), (300, "l000 twin", "two")]
    docs = [(i, train[i * 7][1][4:20] if i % 2 else f"bad {train[i][1][:9]} TWIN l000 " * (1 + 90 * (i == 4)), "old")
            for i in range(20)] + [(90, None, "old"), (91, "", "old"), (92, "1 2", "old")]
    automata = language.parsers(spark.createDataFrame(train, "id long, text string, lang string"))
    assert (len(language._scans(automata, limit)) > 5) == (limit < language.TABLE_BYTES)
    samples = sorted((r["lang"], bytes(r["sample"]), r["size"]) for r in automata.collect())
    frame = spark.createDataFrame(docs, "doc_id long, text string, Score string").withColumn("found", F.lit(1))
    result = language.identify(frame, automata, limit=limit)
    assert result.columns == ["doc_id", "text", "found", "lang_pred", "score"]
    for row in result.collect():
        if row.doc_id >= 90:
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        raw = row.text.encode()
        bits = sorted((plain_phrases(raw, sample) * math.log2(size + 2) / len(raw), name)
                      for name, sample, size in samples)
        assert row.lang_pred == bits[0][1]
        assert row.score == pytest.approx(1 - bits[0][0] / bits[1][0], abs=1e-12)


def test_one_language(spark):
    tuned(spark)
    automata = language.parsers(spark.createDataFrame([("a cat", "en")], "text string, lang string"))
    docs = spark.createDataFrame([("cat",), ("日本",)], "text string")
    assert [(r.lang_pred, r.score) for r in language.identify(docs, automata).collect()] == [("en", 1.0)] * 2


def test_many_sampled_hashes(spark, monkeypatch):
    """Beyond the broadcast bound the sample is joined by shuffle; the same sample comes out."""
    tuned(spark)
    docs = spark.createDataFrame([(f"text number {i % 400} of all", "xyz"[i % 3]) for i in range(1500)],
                                 "text string, lang string")
    first = sorted((r["lang"], bytes(r["sample"])) for r in language.parsers(docs).collect())
    monkeypatch.setattr(language, "BROADCAST_ROWS", 1)
    assert sorted((r["lang"], bytes(r["sample"])) for r in language.parsers(docs).collect()) == first
    assert all(text.count(b"text number") == language.SAMPLE_DOCS for _, text in first)


def test_language_cases(spark):
    tuned(spark)
    train = [(i, "the cat and the dog " * 5, "en") for i in range(3)] + [(9, "der hund und die katze " * 5, "de"),
                                                                        (10, None, "de"), (11, "x", None)]
    trained = language.parsers(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "und die katze"), (2, None), (3, "12 !"), (4, ""), (5, "the cat")],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, trained).collect()}
    assert got[1][0] == "de" and got[5][0] == "en" and got[2] == got[3] == got[4] == ("und", 0.0)


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.encode_special_tokens = True
    odd = ["", " ", "a  b", " a b ", "x\n y\tz \n", "it's 'll 1 2²³ Ⅷ é́ q", "a ​ b", "\x1c a \x1c", "<|endoftext|> x",
           "🙂 🙂‍ a", "a\x85 b", None, "\n", "a\n", "\na", "日本語 テキスト。もう 一", "Привет, мир! 12 34a5", "— “q” t…", "trail ",
           "\n\nx", "x\r\ny", "word " * 5000 + "end"]
    for text, ids in zip(odd, encoded(pa.array(odd), vocabulary())):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 5000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 300, 1 << 16, 1 << 33, 1 << 63):
        values = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        values[rng.random(n) < 0.5] = 0
        words, offsets, exceptions = encode(values)
        assert decode(words, offsets, exceptions, n).tolist() == values.tolist()
        if top <= 1:
            assert len(words) <= -(-n // 60) + len(offsets)


def library_ids(text, end):
    from tokenizers import Tokenizer

    library = library_ids.__dict__.setdefault("own", Tokenizer.from_file(vocabulary()))
    library.encode_special_tokens = True
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_file_query(spark, tiny, duck):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op2_token_files(spark, tiny).collect()}
    start = 0
    for doc_id, text in rows(duck, "select doc_id, text from documents order by doc_id"):
        ids = library_ids(text, 0)
        assert got[doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_cases(spark, docs, tmp_path):
    manifest = token_files.write_token_files(docs, str(tmp_path / "ids"), vocabulary(), file_bytes=2000)
    assert manifest.count() > 1
    found = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 4, 5, 6, 7, 7]
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    assert found[2].n_tokens == found[3].n_tokens == 1
    assert token_files.read_token_files(
        token_files.write_token_files(docs.filter("false"), str(tmp_path / "none"), vocabulary())).count() == 0


def test_packing_query(spark, tiny, duck):
    found = queries.op9_packing(spark, tiny).collect()
    texts = dict(rows(duck, "select doc_id, text from documents"))
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, parts in by_doc.items():
        ids, at = library_ids(texts[doc_id], 1), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in found) > 0.97 * 2048 * len(by_sequence)


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = sorted(rng.integers(1, 21, rng.integers(0, 40)).tolist(), reverse=True)
        bins, offsets = packing.first_fit(lengths, 20)
        room = []
        for length, b, offset in zip(lengths, bins, offsets):
            want = next((i for i, r in enumerate(room) if r >= length), len(room))
            if want == len(room):
                room.append(20)
            assert (b, offset) == (want, 20 - room[want])
            room[want] -= length


def test_packing_keeps_ids(spark, docs):
    found = packing.pack(docs, vocabulary(), length=64, group_pieces=10, with_ids=True).collect()
    whole = Counter()
    for r in found:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        whole[r.doc_id] += r.length
    assert whole[2] == whole[3] == 1 and whole[7] == 2 * len(library_ids(TEXTS[6][1], 1))
