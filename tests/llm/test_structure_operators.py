"""Runs of words, exact copies and the conversation trie against plain re-computations."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as contract
import oracle
from wayfare.llm import conversations, exact_copies, queries, runs
from wayfare.llm.common import tuned
from wayfare.llm.words import SPACED, scan

WORD = r"[^\x20\x09-\x0D]+"


def rows(duck, sql):
    return duck.execute(sql).fetchall()


# runs


def plain_runs(words):
    ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int)
    n, found = len(ids), {}
    for q in range(1, n // 2 + 1):
        equal = np.concatenate([[False], ids[:-q] == ids[q:], [False]]).astype(int)
        starts, ends = np.flatnonzero(np.diff(equal) == 1), np.flatnonzero(np.diff(equal) == -1)
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s + q >= max(12, 2 * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_small_alphabets():
    rng = np.random.default_rng(5)
    texts = []
    for trial in range(1500):
        n = int(rng.integers(0, 140))
        letters = rng.integers(0, int(rng.integers(1, 4)) + 1, n)
        if trial % 3 == 0 and n:  # a period planted
            a, p = int(rng.integers(0, n)), int(rng.integers(1, 30))
            letters[a:] = letters[a + (np.arange(n - a) % min(p, n - a))]
        texts.append([chr(97 + c) for c in letters.tolist()])
    def fibonacci(a, b, n):
        return a if not n else fibonacci(b, b + a, n - 1)
    texts += [list(fibonacci("a", "ab", 9)), ["a"] * 700, list("ab" * 300 + "c" + "ab" * 300), list("aabaab" * 40)]
    data = "\n".join(" ".join(t) for t in texts).encode()
    ends = np.cumsum([0] + [len(" ".join(t)) + 1 for t in texts])
    ends[-1] = len(data)
    words = scan(np.frombuffer(data, np.uint8), ends, SPACED)
    start, end, period = runs.runs_of(words)
    first = np.concatenate([[0], np.cumsum(words.counts)])
    got = defaultdict(list)
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        got[int(words.rows[s])].append((s - int(first[words.rows[s]]), e - s, q))
    for i, text in enumerate(texts):
        assert got[i] == plain_runs(text), " ".join(text)


def test_seeds_grow_with_the_text_only():
    for text in (["a"] * 20_000, ["a", "b"] * 10_000, (["a"] * 50 + ["b"]) * 400):
        words = np.array([hash(w) % 2**62 for w in text], np.uint64)
        n, k, low, high, total = len(words), 6, 1, 12, 0
        while 2 * k < n:
            names = np.unique(np.lib.stride_tricks.sliding_window_view(words, k), axis=0, return_inverse=True)[1]
            total += len(runs._seeds(np.arange(n - k + 1), names.ravel(), k, low, high, n)[0])
            k, low, high = 2 * k, 2 * k, 4 * k
            if k > 200:
                break
        assert total <= 8 * n


def made_periodic(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_query(spark, tiny, duck):
    got = {r.doc_id: r for r in queries.op11_runs(spark, tiny).collect()}
    texts = rows(duck, "select doc_id, text from documents")
    assert len(got) == len(texts)
    for doc_id, text in texts:
        words = made_periodic(doc_id, re.findall(WORD, text or ""))
        found, r = plain_runs(words), got[doc_id]
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()


def test_runs_cases(spark):
    long = "la " * 150_000 + "é"
    texts = [(1, None), (1, ""), (2, " \t\n"), (None, "a\x0bb " * 6), (3, "a b " * 5 + "a"), (4, long), (4, long),
             (5, "x y\nz " * 4 + "\x00 q")]
    docs = tuned(spark).createDataFrame([(*t, "f", 1) for t in texts], "id long, text string, found string, runs int")
    found = runs.with_runs(docs).collect()
    assert [r.id for r in found] == [i for i, _ in texts] and found[0].runs == 1
    for r, (_, text) in zip(found, texts):
        words = re.findall(WORD, text or "")
        want = [(0, 150_000, 1)] if text == long else plain_runs(words)
        assert [tuple(x) for x in r.found.runs] == want and r.found.n_words == len(words)
        assert r.found.collapsed == plain_collapsed(words, want)
    assert runs.with_runs(docs.filter("false")).count() == 0


# exact copies


def test_exact_copies_sql(spark, duck, tiny):
    sql = contract.oracle_sql()["op12_exact_copies"]
    assert oracle.difference(queries.op12_exact_copies(spark, tiny), duck, sql) is None


@pytest.mark.parametrize("parts, bits", [(1, 4), (3, 1), (40, 1), (40, 4)])
def test_exact_copies_cases(spark, parts, bits):
    texts = ["a b", "a \t\r b", "a\x0b\x0cb", " a b", "", None, "é" * 50_000, "a b "]
    table = [(i * 7 % 40, texts[i % len(texts)]) for i in range(60)] + [(None, "a b"), (None, "lone"), (2, "hot")]
    table += [(1, "hot")] * 30
    docs = spark.createDataFrame([(*r, True, b"") for r in table], "doc_id long, text string, kept boolean, digest binary")
    found = exact_copies.exact_copies(docs.repartition(parts), fan_bits=bits).collect()
    groups = defaultdict(list)
    for doc_id, text in table:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).digest()].append(doc_id)
    want = Counter()
    for digest, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        want.update((i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids))
    assert Counter((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in found) == want
    kept = exact_copies.keep_first(docs.repartition(parts))
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(
        ids[0] for ids in groups.values())
    assert exact_copies.exact_copies(docs.filter("false")).count() == 0


def test_exact_copies_stay_native(spark, tiny):
    plan = queries.op12_exact_copies(spark, tiny)._jdf.queryExecution().toString()
    assert "SortAggregate" in exact_copies.merged(
        spark.createDataFrame([], "run long, digest binary, size int, check long, first struct<a: int>, n long"),
        1)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# conversations


def plain_trie(turns):
    """{(smallest member, depth): row} of the plain definition; turns is {conversation: [(role, text)]}."""
    members, ends, size = defaultdict(list), defaultdict(list), {}
    for conv, steps in turns.items():
        for d in range(len(steps) + 1):
            members[tuple(steps[:d])].append(conv)
        ends[tuple(steps)].append(conv)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted((min(own), len(node), min(members[node[:-1]]) if node else -1, len(own), children[node],
                   leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
                  for node, own in members.items())


def found_trie(lists, task_turns):
    paths = conversations.sequences(lists)
    nodes = conversations.prefix_trie(paths, task_turns).join(conversations.end_digests(paths), "id", "left")
    none = hashlib.sha256(b"").hexdigest()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256 or none) for r in nodes.collect())


def test_trie_sql(spark, duck, tiny):
    sql = contract.oracle_sql()["op13_conversation_trie"]
    assert oracle.difference(queries.op13_conversation_trie(spark, tiny), duck, sql) is None


def test_trie_query(spark, duck, tiny):
    own = defaultdict(list)
    for conv, turn, role, text in sorted(rows(duck, "select * from conversations"), key=lambda r: r[:2]):
        own[conv].append((role or "", text or ""))
    rebuilt = {}
    for conv, steps in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt[conv] = own.get(conv - conv % 5, [])[:h] + steps[h:]
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                  r.n_leaves, r.saved_tokens, r.ends_sha256) for r in queries.op13_conversation_trie(spark, tiny).collect())
    assert got == plain_trie(rebuilt)


@pytest.mark.parametrize("task_turns", [15, 60, 10_000])
def test_trie_cases(spark, task_turns):
    rng = np.random.default_rng(3)
    turns = {}
    for conv in range(120):
        steps = [("user", "x" * int(rng.integers(1, 4))) for _ in range(int(rng.integers(1, 12)))]
        turns[conv] = [("system", "hot"), *steps] if conv % 3 else steps
    turns[200] = turns[201] = [("system", "hot")] * 90
    turns[202] = [("system", "hot")] * 40 + [("user", "x")]
    turns[203] = [("", "")]
    table = [(c, n, *s, n) for c, steps in turns.items() for n, s in enumerate(steps)]
    table += [(None, 1, "user", "x", 0)]
    table = [(c, None if n == 0 else n, r or None, t or None, d) for c, n, r, t, d in table]
    frame = tuned(spark).createDataFrame(table, "conv_id long, turn long, role string, text string, depth long")
    got = found_trie(conversations.turn_lists(frame.repartition(7)), task_turns)
    assert got == plain_trie(turns)


def test_trie_of_turnless_and_no_conversations(spark):
    lists = spark.createDataFrame([(4, []), (2, [])], "conv_id long, steps array<struct<turn: long, mark: binary, bytes: long>>")
    assert found_trie(lists, 10) == plain_trie({4: [], 2: []})
    assert found_trie(lists.filter("false"), 10) == []


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            want = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert conversations.two_fattest(low, high) & -conversations.two_fattest(low, high) == want & -want


def test_fat_search_finds_the_deepest_node():
    rng = np.random.default_rng(9)
    trie, seen = conversations.ZFastTrie(), []
    for _ in range(30):
        batch = []
        for _ in range(20):
            path = [b""]
            for turn in rng.integers(0, 3, int(rng.integers(0, 40))):
                path.append(hashlib.md5(path[-1] + bytes([turn])).digest())
            batch.append((path[1:], [1] * (len(path) - 1), 1, len(seen) + len(batch)))
        trie.insert_batch(batch)
        seen += batch
        for path, *_ in seen[:: 1 + len(seen) // 50]:
            at = trie.locate(path)
            assert trie.high[at] == len(path) and trie.path[at][:len(path)] == path
    assert trie.handles.keys() >= {trie.path[v][conversations.two_fattest(trie.low[v], trie.high[v]) - 1]
                                   for v in range(1, len(trie.low))}
    assert len(trie.handles) == len(trie.low) - 1
