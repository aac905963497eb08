"""Archives, shards, URLs, repeats, near copies and the pipeline against plain re-computations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
import oracle
from wayfare.llm import ngram_join, queries, repeats, sharding, urls, warc
from wayfare.llm.common import row_key, table, tuned, written
from wayfare.llm.components import components
from wayfare.llm.suffix_array import permuted_prefixes, repeated_starts, suffix_array


def rows(duck, sql):
    return duck.execute(sql).fetchall()


# archives


def plain_warc(pages):
    first = {}
    for page_id, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            key = hashlib.sha256(data).hexdigest()
            first[key] = min(first.get(key, page_id), page_id)
    out = []
    for page_id, html in pages:
        data = (html or "").encode()
        key = hashlib.sha256(data).hexdigest()
        own = first.get(key, page_id) if len(data) >= 100 else page_id
        out.append((page_id, len(data), key, "response" if own == page_id else "revisit",
                    None if own == page_id else own))
    return sorted(out, key=str)


def test_warc_query(spark, tiny, duck):
    found = queries.op3_warc(spark, tiny).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == plain_warc(rows(duck, "select page_id, html from pages"))


def test_warc_sql(spark, duck, tiny):
    sql = contract.oracle_sql()["op3_warc"]
    assert oracle.difference(queries.op3_warc(spark, tiny), duck, sql) is None


def test_warc_cases(spark, monkeypatch):
    tuned(spark)
    long = "é\r\n\r\nWARC/1.1\r\n" * 20
    pages = [(5, "http://a/ b\r\nX: y", long), (3, None, long), (9, "http://c", long), (4, "u", None), (6, "u", ""),
             (7, "u", "short"), (8, "u", "short"), (10, "u", "z" * 300_000)]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in pages],
                               "page_id long, url string, html string, digest string, length int")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    index, folder = warc.write_archives(df)
    assert index.select("archive").distinct().count() > 1
    found = warc.read_records(index, folder, with_payload=True).collect()
    assert sorted(((int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type,
                    int(r.refers_to) if r.refers_to else None) for r in found), key=str) == \
        plain_warc([(i, h) for i, _, h in pages])
    payload = {int(r.page_id): bytes(r.payload) for r in found}
    assert payload[3] == long.encode() and payload[9] == b"" and payload[10] == b"z" * 300_000
    one = warc.read_records(index.filter("page_id = 3"), folder).collect()
    assert [r.page_id for r in one] == ["3"]
    few = warc.byte_ranges(index, read_bytes=1 << 30, gap=1 << 30)
    assert few.count() == index.select("archive").distinct().count()
    empty = warc.write_archives(df.filter("false"))
    assert empty[0].count() == 0


def test_every_archive_is_one_task(spark, monkeypatch):
    """However many archives there are, no task writes two of them and the read-back is whole."""
    tuned(spark)
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 30) for i in range(2000)],
                                  "page_id long, url string, html string")
    kept = {}
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 16_000)
    monkeypatch.setattr(warc, "written", lambda df, name, *parts: kept.setdefault(name, written(df, name, *parts)))
    index, folder = warc.write_archives(pages)
    files = kept["archives"].groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 30 and all(r["count"] == 1 for r in files)
    assert index.select("archive").distinct().count() == len(files)
    assert sorted(int(r.page_id) for r in warc.read_records(index, folder).collect()) == list(range(2000))


# shards


def plain_shard_rules(found, texts):
    by_shard = defaultdict(list)
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        by_shard[r.shard].append(r)
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    return {s: sum(r.size for r in members) for s, members in by_shard.items()}


def test_shard_query(spark, tiny, duck):
    found = queries.op4_sharding(spark, tiny).collect()
    texts = dict(rows(duck, "select doc_id, text from documents"))
    assert sorted(r.doc_id for r in found) == sorted(texts)
    sizes = plain_shard_rules(found, texts)
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in found)


def test_shards_of_a_hot_text(spark):
    tuned(spark)
    rng = random.Random(4)
    texts = {i: "hot " * 50 if i % 3 == 0 else f"{i} " * rng.randint(1, 90) for i in range(4000)}
    texts[4001], texts[4002] = None, ""
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id long, text string, shard int")
    found = sharding.shard_by_bytes(df).collect()
    sizes = plain_shard_rules(found, texts)
    assert max(sizes.values()) < 1.03 * min(sizes.values())
    assert [tuple(r) for r in sorted(found)] == [tuple(r) for r in sorted(sharding.shard_by_bytes(df).collect())]
    assert sharding.shard_by_bytes(df.filter("false")).count() == 0


def test_shards_numbered_in_parts(spark, monkeypatch):
    """Places stay gapless when a range is numbered in several parts, and shards do not move."""
    tuned(spark)
    texts = {i: "same text" if i % 3 == 0 else f"{i} words" for i in range(2000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    shards = {r.doc_id: r.shard for r in sharding.shard_by_bytes(df, 3, ranges=4).collect()}
    monkeypatch.setattr(sharding, "PART_ROWS", 30)
    found = sharding.shard_by_bytes(df, 3, ranges=4).collect()
    plain_shard_rules(found, texts)
    assert {r.doc_id: r.shard for r in found} == shards


def test_shards_of_other_ids(spark):
    """Ids that are no numbers, NULL ones and a row repeated many times."""
    tuned(spark)
    names = [f"doc-{i}" for i in range(300)] + [None, None] + ["twin"] * 500
    df = spark.createDataFrame([(n, f"text of {n}") for n in names], "name string, text string")
    found = sharding.shard_by_bytes(df, id_col="name").collect()
    assert Counter(r.doc_id for r in found) == Counter(names)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r.shard for r in found if r.doc_id == "twin"}) == 1


# URLs


def plain_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in queries.URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            best = rule if best is None or len(rule) > len(best) else best
    return host, path, best


def test_url_query(spark, tiny, duck):
    got = {r.page_id: r for r in queries.op5_url_filter(spark, tiny).collect()}
    for page_id, url in rows(duck, "select page_id, url from pages"):
        r, plain = got[page_id], plain_rule(url)
        assert (r.host, r.path, r.rule) == plain
        assert r.verdict == queries.URL_RULES[plain[2]] if plain[2] else r.verdict in ("allow", "block")


def test_url_cases(spark):
    tuned(spark)
    texts = ["HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com/en", "http://xcom/", None, "", "no",
             "http://a.net/es/1", "http://É.com/a/b", "http://com/", "://com/x", "a://b://c.com/"]
    texts += [f"http://news{i}.com/story/{i}" for i in range(200)] + [f"http://xx{i}.net/es/zz?q={i}" for i in range(200)]
    texts += ["http://news.org/story/5", "http://xx.org/es/zz?q=5"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(texts)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urls.judge(pages, queries.URL_RULES).collect()}
    for i, url in enumerate(texts):
        assert (got[i].host, got[i].path, got[i].rule) == plain_rule(url)
    assert got[len(texts) - 2].verdict == "allow" and got[len(texts) - 1].verdict == "block"
    few = urls.judge(pages.filter("page_id < 2 or url is null"), {"com/": "allow"}).collect()
    assert {r.verdict for r in few} == {"allow"}
    assert urls.judge(pages.filter("false"), queries.URL_RULES).count() == 0


def test_urls_that_differ_in_real_bytes_only(spark, monkeypatch):
    """Digits, scripts and marks tell URLs apart, also by what stands more than three bytes before;
    a joined model says the same as a broadcast one."""
    tuned(spark)
    texts = []
    for i in range(300):
        texts += [f"http://a{i}.com/10.20.30.40/да_{i}", f"http://a{i}.net/es/50.60.70.80/ελ%{i}"]
        texts += [f"http://b{i}.com/x1abcdey", f"http://b{i}.net/es/x2abcdez"]
    asked = ["http://10.20.30.40/", "http://50.60.70.80/", "http://q.org/да", "http://q.org/ελ",
             "http://q.org/x1abcdey", "http://q.org/x1abcdez", None, ""]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*asked, *texts, *asked])], "page_id long, url string")
    rules = {"com/": "allow", "net/es/": "block"}
    found = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    score = [found[i].score for i in range(len(asked))]
    assert score[0] > score[1] and score[2] > score[3] and score[4] > score[5]
    assert [found[i].verdict for i in (0, 1, 2, 3)] == ["allow", "block", "allow", "block"]
    monkeypatch.setattr(urls, "SMALL_MODEL", 0)
    joined = {r.page_id: r for r in urls.judge(pages, rules).collect()}
    assert len(joined) == len(found) == pages.count()
    for i, r in found.items():
        assert joined[i].score == pytest.approx(r.score, abs=1e-8)
        assert joined[i].verdict == r.verdict


def test_url_model_is_a_distribution():
    counts = np.random.default_rng(0).integers(0, 3, urls.CLASSES ** (urls.ORDER + 1))
    total = np.exp(urls.log_probabilities(counts)).reshape(-1, urls.CLASSES).sum(1)
    assert np.allclose(total, 1)


# suffix arrays and repeats


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        k = rng.randint(1, 4)
        text = np.array([rng.randint(1, k) for _ in range(rng.randint(0, 60))] + [0], np.uint16)
        plain = text.tolist()
        order = suffix_array(text, k + 1, 10**6)
        assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        _, shared = permuted_prefixes(text, order, 1000)
        for a, b in zip(order[1:], order[:-1]):
            n = 0
            while max(a, b) + n < len(plain) and plain[a + n] == plain[b + n]:
                n += 1
            assert shared[a] == n


def test_repeated_starts():
    rng = random.Random(2)
    for _ in range(150):
        parts = [np.array([rng.randint(0, 2) for _ in range(rng.randint(0, 40))], np.uint8) for _ in range(rng.randint(0, 6))]
        size = rng.randint(1, 6)
        count = Counter(bytes(p[i:i + size]) for p in parts for i in range(len(p) - size + 1))
        assert [f.tolist() for f in repeated_starts(parts, size)] == [
            [count[bytes(p[i:i + size])] > 1 for i in range(len(p) - size + 1)] for p in parts]


def plain_repeats(texts, size=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - size + 1):
            if count[d[i:i + size]] > 1:
                gone[i:i + size] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept))
    return out


def test_repeats_query(spark, tiny, duck):
    found = {r.doc_id: r for r in queries.op6_suffix_dedup(spark, tiny).collect()}
    docs = rows(duck, "select doc_id, text from documents")
    for (doc_id, text), (removed, spans, kept) in zip(docs, plain_repeats([t for _, t in docs])):
        r = found[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len((text or "").encode()), removed, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("core_bytes", [1 << 18, 2000])
def test_repeats_cases(spark, core_bytes):
    """Also with crowded cores: a common line of 190 bytes and a common passage amid unlike texts."""
    tuned(spark)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    line, passage = noise(170)[:170], noise(400)
    texts = [noise(300) + line + noise(300) for _ in range(15)]
    texts += [noise(rng.randint(0, 250)) + passage + noise(rng.randint(0, 250)) for _ in range(15)]
    texts += [passage, passage, None, "", "short", "short", "a" * 1000, noise(150) + "ab" * 300, texts[0][:260], noise(5000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    docs = docs.union(docs.filter("doc_id = 39"))  # a repeated row
    texts = texts + [texts[39]]
    found = repeats.without_repeats(docs.drop("found"), core_bytes=core_bytes, shard_bytes=20_000).collect()
    got = sorted((r.doc_id, r.found["removed"], r.found["n_spans"], bytes(r.found["kept"])) for r in found)
    ids = [*range(len(texts) - 1), 39]
    assert got == sorted((i, *x) for i, x in zip(ids, plain_repeats(texts)))
    assert repeats.without_repeats(docs.filter("false").drop("found")).count() == 0


# near copies


def plain_classes(docs):
    sets = {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets[doc_id] = {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    owners = defaultdict(list)
    for doc_id, own in sets.items():
        for x in own:
            owners[x].append(doc_id)
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, own in sets.items():
        for b, shared in Counter(b for x in own for b in owners[x] if b > a).items():
            if 10 * shared >= 8 * (len(own) + len(sets[b]) - shared):
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {(i, find(i), links[i]) for i in sets}


def test_join_query(spark, tiny, duck):
    found = {tuple(r) for r in queries.op7_ngram_join(spark, tiny).collect()}
    assert found == plain_classes(rows(duck, "select doc_id, text from documents"))


@pytest.mark.parametrize("limits", [{}, {"bucket_rows": 4, "block_rows": 5}])
def test_join_cases(spark, limits):
    """A chain of near copies, copies, short and empty texts; also with large groups in tiles."""
    tuned(spark)
    rng = random.Random(6)
    base = [str(rng.random()) for _ in range(150)]
    texts = []
    for i in range(40):
        base[rng.randrange(150)] = str(i)
        texts.append(" ".join(base))
    texts += [texts[3], texts[3] + " ", "a b", "a  b", "a b c", None, "", " ", "x " * 30, "x " * 60]
    docs = [(i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, node string")
    found = ngram_join.near_duplicates(df, **limits).select("doc_id", "class_id", "n_links").collect()
    assert {tuple(r) for r in found} == plain_classes(docs)
    kept = {r.doc_id for r in ngram_join.keep_first(df.union(df)).collect()}
    classes = plain_classes(docs)
    assert kept == {c for _, c, _ in classes}
    assert ngram_join.keep_first(df.union(df)).filter("text like '%0.%'").count() == len(
        {c for i, c, _ in classes if "0." in (texts[i - 1] or "")})
    assert ngram_join.near_duplicates(df.filter("false")).count() == 0


def test_prefix_depth():
    assert ngram_join.recall(1, 1, 0.8) == pytest.approx(0.8)
    depth = ngram_join.prefix_depth(24, 0.8, 0.99999)
    assert ngram_join.recall(depth, 24, 0.8) >= 0.99999 > ngram_join.recall(depth + 1, 24, 0.8)


def test_trees_make_up_for_length():
    for depth in (4, 8, 12):
        n = ngram_join.trees_for(depth, 0.8, 0.99999)
        assert ngram_join.recall(depth, n, 0.8) >= 0.99999 > ngram_join.recall(depth, n - 1, 0.8)


def test_longer_paths_go_on_from_shorter():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 40).astype(np.uint64)
    rows = np.repeat([0, 1], 20)
    short, long = (ngram_join._least(rows, hashes, 3, trees, depth)[3] for trees, depth in ((4, 2), (9, 5)))
    assert (long[:, :4, :2] == short).all() and not short[2].any()


def template_family(n, words=60, own=9, pairs=20):
    """Texts alike by a template, too little for links, and some near copies of a few of them."""
    rng = random.Random(3)
    texts = []
    for i in range(n):
        text = [f"t{w}" for w in range(words)]
        for at in rng.sample(range(words // own), 2):
            text[at * own] = f"{i}-{at}"
        texts.append(" ".join(text))
    return texts + [f"{t} tail{i}" for i, t in enumerate(texts[:pairs])]


def test_crowded_prefixes_are_lengthened(spark):
    """A crowded family is compared in fewer pairs than by the shortest prefix, and loses no link."""
    tuned(spark)
    docs = list(enumerate(template_family(400), 1))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = ngram_join.near_duplicates(df, bucket_rows=16).select("doc_id", "class_id", "n_links").collect()
    assert {tuple(r) for r in found} == plain_classes(docs)
    rows = df.select(*row_key("doc_id", "text"), "doc_id", "text")
    sign = ngram_join.signature_column(5, ngram_join.TREES, 4)
    nodes = written(rows.select("ka", "kb", "doc_id", sign("text").alias("s")).select(
        "s.node", "s.keys", F.struct("doc_id", "ka", "kb").alias("first")), "family")

    def pairs(limit):
        stands = ngram_join.forest(nodes, rows, 5, 0.8, ngram_join.TREES, ngram_join.RECALL, limit)
        prefixes = stands.select("key", "size").distinct()
        return prefixes.agg(F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()[0]

    assert pairs(16) < pairs(10_000) / 2


@pytest.mark.parametrize("limit", [1000, 4])
def test_components(spark, limit):
    """Also with hubs above the limit, whose edges are salted."""
    tuned(spark)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), limit=limit).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# the pipeline


def test_pipeline(spark, tiny, duck):
    docs = table(spark, tiny, "documents")
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, tiny), name)
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(texts[name]) <= set(before)
        assert docs.filter("n_chars is distinct from length(text)").isEmpty()
        if name == "ngram_jaccard_join":
            assert set(texts[name]) == {c for _, c, _ in plain_classes(before.items())}
        if name == "suffix_array_dedup":
            for (i, _), (_, _, kept) in zip(before.items(), plain_repeats(before.values())):
                assert texts[name][i] == kept.decode("utf-8", "ignore")
    packed = corpus_pipeline.run(spark, tiny)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts["benchmark_decontamination"])


@pytest.mark.parametrize("rows_of", ["odd", "none"])
def test_pipeline_cases(spark, tiny, rows_of):
    tuned(spark)
    odd = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, 0),
           (3, "a b " * 4000, "xx", "s", 1), (3, "a b " * 4000, "xx", "s", 1), (None, "word", "en", "s", 4)]
    docs = spark.createDataFrame(odd if rows_of == "odd" else [],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tiny).count() <= max(2 * len(odd) if rows_of == "odd" else 0, 0) + 40
