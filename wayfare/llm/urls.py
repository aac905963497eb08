"""URL filters: host and path rules, and a language-model ratio for URLs no rule decides.

Smoothed Markov models of variable order are counted from all URLs that the rules accept and all that
they reject. Characters in 32 classes, with up to ORDER classes before them, are the base. On it stand
contexts over the real bytes: the ORDER classes before, with the last 0, 1, ... LONGEST bytes exact.
Each leans on the shorter one by Witten and Bell's weights. Contexts with exact bytes are kept if they
occur at least twice and pay by the Bayesian information criterion: twice their gain in
log-likelihood over the shorter context exceeds the kinds of bytes after them times ln(bytes counted).
The table of contexts so grows with the input; above SMALL_MODEL entries it is joined, not broadcast.
A URL's score is the mean log-likelihood difference per byte; the cutoff is the one that parts a
held-out quarter of the decided URLs best.

Gathered are the counts of the classes, 32^(ORDER + 1) whatever the input. 64-bit hashes stand for
contexts. Without decided URLs on both sides everything undecided is allowed. NULL and URLs without
`://` have an empty host and path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import lists, mixed, pieces, vectorized, written
from wayfare.operators.skew import salted_join

ORDER = 3
CLASSES = 32
LONGEST = 8
SMALL_MODEL = 1 << 20  # bytes after contexts that are broadcast, some 40 bytes each
STEP = 1000  # bins of a score per unit
REACH = 20 * STEP

# 0 begins a URL, 1-26 letters, 27 digits, 28-30 marks of hosts and paths, 31 all others
_CLASS = np.full(256, 31, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = 27
for _mark, _number in zip(b"./-", (28, 29, 30)):
    _CLASS[_mark] = _number

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return (F.translate(host, _UPPER, _UPPER.lower()),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and the beginning of the path."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def _codes(data: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    """Per order, the number of each character together with so many before it."""
    own = _CLASS[data]
    place = np.arange(len(data)) - np.repeat(borders[:-1], np.diff(borders))
    out, code = [own], own
    for back in range(1, ORDER + 1):
        before = np.zeros(len(data), np.int64)
        before[back:] = own[:-back]
        before[place < back] = 0
        code = code + before * CLASSES**back
        out.append(code)
    return out


@vectorized("array<int>")
def _contexts(url: pa.Array) -> pa.Array:
    parts = [(_codes(d, b)[-1], np.diff(b)) for d, b in pieces(url)]
    if not parts:
        return pa.array([], pa.list_(pa.int32()))
    return lists(np.concatenate([p[0] for p in parts]).astype(np.int32),
                 np.concatenate([p[1] for p in parts]), pa.int32())


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """ln P(character | ORDER before it) for every code, from counts of the codes."""
    prob = np.full((1, CLASSES), 1 / CLASSES)
    for order in range(ORDER + 1):
        # axes: context characters from far to near, then the character
        seen = counts.reshape(-1, CLASSES**order, CLASSES).sum(0).astype(float)
        total, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
        lower = np.tile(prob, (len(seen) // len(prob), 1))
        prob = np.where(total > 0, (seen + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return np.log(prob).ravel()


def _keys(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class codes, hashes of the contexts with 0 to LONGEST exact bytes, and how many of them there
    are: the last reaches the beginning of the URL, which counts as a byte."""
    codes = _codes(data, borders)[-1]
    place = np.arange(len(data)) - np.repeat(borders[:-1], np.diff(borders))
    keys = np.zeros((LONGEST + 1, len(data)), np.uint64)
    keys[0] = mixed(codes // CLASSES + 1)
    for back in range(1, LONGEST + 1):
        before = np.zeros(len(data), np.uint64)
        before[back:] = data[:-back].astype(np.uint64) + np.uint64(1)
        before[place < back] = 0
        keys[back] = mixed(keys[back - 1] + before + np.uint64(1))
    return codes, keys, np.minimum(place + 1, LONGEST) + 1


def _entry(key: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The hash of a context and the byte after it."""
    return mixed(key.astype(np.uint64) + (byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _structs(parts: list, kinds: dict[str, pa.DataType]) -> pa.ListArray:
    """A list column of structs from (rows' lengths, columns) of each piece."""
    counts = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
    columns = [pa.concat_arrays([pa.array([], kind), *[p[1][i] for p in parts]])
               for i, kind in enumerate(kinds.values())]
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names=list(kinds)))


@vectorized("array<struct<ctx: long, shorter: long, byte: int>>")
def _grams(url: pa.Array) -> pa.Array:
    """Every byte after every context of it. The first has 0 as its shorter one."""
    parts = []
    for data, borders in pieces(url):
        _, keys, depth = _keys(data, borders)
        there = (np.arange(LONGEST + 1) < depth[:, None])
        shorter = np.vstack([np.zeros((1, len(data)), np.uint64), keys[:-1]])
        total = np.concatenate([[0], np.cumsum(depth)])
        parts.append((total[borders[1:]] - total[borders[:-1]], [
            pa.array(keys.T[there].view(np.int64)), pa.array(shorter.T[there].view(np.int64)),
            pa.array(np.repeat(data, depth).astype(np.int32))]))
    return _structs(parts, {"ctx": pa.int64(), "shorter": pa.int64(), "byte": pa.int32()})


def class_logs(counted: DataFrame) -> tuple[np.ndarray, bool]:
    """Log-probability per code, rejected and accepted; whether both sides were seen.

    `counted` has rows (accepted, code, n): no more than two models have codes.
    """
    seen = np.zeros((2, CLASSES**(ORDER + 1)), np.int64)
    for row in counted.toLocalIterator():
        seen[int(row["accepted"]), row["code"]] = row["n"]
    both = bool(seen[0].any() and seen[1].any())
    return np.stack([log_probabilities(seen[0]), log_probabilities(seen[1])]), both


def byte_logs(model: DataFrame) -> np.ndarray:
    """Log-probability of each byte within its class, rejected and accepted."""
    rows = (model.filter("shorter = 0").select(F.explode("next").alias("e"))
            .groupBy("e.byte").agg(F.sum("e.n0").alias("n0"), F.sum("e.n1").alias("n1")))
    seen = np.ones((2, 256))
    for row in rows.collect():
        seen[:, row["byte"]] += (row["n0"], row["n1"])
    return np.log(seen) - np.log(np.stack([np.bincount(_CLASS, s, CLASSES)[_CLASS] for s in seen]))


def contexts(decided: DataFrame) -> DataFrame:
    """The contexts that pay: (ctx, shorter, n0, n1, k0, k1, next).

    Per side, n counts the bytes after a context and k their kinds; `next` has them one by one.
    """
    grams = decided.select(F.col("accepted").cast("long").alias("one"), F.explode(_grams("url")).alias("g"))
    each = grams.groupBy("g.ctx", "g.shorter", "g.byte").agg(
        F.sum(1 - F.col("one")).alias("n0"), F.sum("one").alias("n1"))
    found = each.groupBy("ctx", "shorter").agg(
        *[F.sum(n).alias(n) for n in ("n0", "n1")],
        *[F.count_if(F.col(n) > 0).alias(k) for n, k in (("n0", "k0"), ("n1", "k1"))],
        F.collect_list(F.struct("byte", "n0", "n1")).alias("next"))
    found = written(found.filter("shorter = 0 or n0 + n1 > 1"), "contexts")
    total = found.filter("shorter = 0").agg(F.sum(F.col("n0") + F.col("n1"))).first()[0] or 1
    of = found.select(F.col("ctx").alias("shorter"), F.col("n0").alias("m0"), F.col("n1").alias("m1"),
                      F.map_from_entries(F.transform("next", lambda e: F.struct(e.byte, e))).alias("below"))

    def gain(side: int):
        n, all_n, all_m = f"n{side}", F.col(f"n{side}"), F.col(f"m{side}")
        return F.aggregate("next", F.lit(0.0), lambda total, e: total + F.when(
            e[n] > 0, e[n] * F.log(e[n] * all_m / (all_n * F.element_at("below", e.byte)[n]))).otherwise(0.0))

    longer = found.filter("shorter <> 0").join(of, "shorter")
    longer = longer.filter(2 * (gain(0) + gain(1)) > (F.col("k0") + F.col("k1")) * float(np.log(total)))
    return written(found.filter("shorter = 0").unionByName(longer.select(found.columns)), "model")


def _by_broadcast(model: DataFrame, base: np.ndarray, own: np.ndarray):
    """A column function of a URL's score by a model that is sent to every task."""
    heads = model.select("ctx", "n0", "n1", "k0", "k1").toArrow()
    rows = model.select("ctx", F.explode("next").alias("e")).select("ctx", "e.*").toArrow()
    ctx = heads["ctx"].to_numpy().astype(np.uint64)
    order = np.argsort(ctx)
    heads = np.stack([heads[c].to_numpy()[order] for c in ("n0", "n1", "k0", "k1")]).astype(np.int64)
    entry = _entry(rows["ctx"].to_numpy(), rows["byte"].to_numpy())
    by_entry = np.argsort(entry)
    seen = np.stack([rows[c].to_numpy()[by_entry] for c in ("n0", "n1")]).astype(np.int64)
    shared = model.sparkSession.sparkContext.broadcast((ctx[order], heads, entry[by_entry], seen, base, own))

    def find(sorted_keys, keys):
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    @vectorized("double")
    def score(url: pa.Array) -> pa.Array:
        ctx, heads, entry, seen, base, own = shared.value
        parts = [np.zeros(0)]
        for data, borders in pieces(url):
            codes, keys, depth = _keys(data, borders)
            p = np.exp(base[:, codes] + own[:, data])
            for back in range(LONGEST + 1 if len(ctx) else 0):
                at, known = find(ctx, keys[back])
                at_entry, hit = find(entry, _entry(keys[back], data))
                n = np.where(known & (back < depth), heads[:2, at], 0)
                k, x = heads[2:, at], np.where(hit, seen[:, at_entry], 0)
                p = np.where(n > 0, (x + k * p) / np.maximum(n + k, 1), p)
            total = np.concatenate([[0], np.cumsum(np.log(p[1]) - np.log(p[0]))])
            parts.append((total[borders[1:]] - total[borders[:-1]]) / np.maximum(np.diff(borders), 1))
        return pa.array(np.round(np.concatenate(parts), 9), pa.float64())

    return score


_WINDOW = {"w": pa.int64(), "byte": pa.int32(), "p0": pa.float64(), "p1": pa.float64(),
           "ctxs": pa.list_(pa.int64())}


def _by_join(pages: DataFrame, url: Column, model: DataFrame, base: np.ndarray, own: np.ndarray) -> DataFrame:
    """(ua, ub, score) of every distinct URL by a model that is not broadcast.

    A window is a byte with its longest context; each distinct one meets the contexts once.
    """
    shared = pages.sparkSession.sparkContext.broadcast((base, own))

    @vectorized("array<struct<w: long, byte: int, p0: double, p1: double, ctxs: array<long>>>")
    def split(url: pa.Array) -> pa.Array:
        base, own = shared.value
        parts = []
        for data, borders in pieces(url):
            codes, keys, depth = _keys(data, borders)
            p = np.exp(base[:, codes] + own[:, data])
            w = _entry(keys[depth - 1, np.arange(len(data))], data)
            there = np.arange(LONGEST + 1) < depth[:, None]
            parts.append((np.diff(borders), [
                pa.array(w.view(np.int64)), pa.array(data.astype(np.int32)), pa.array(p[0]), pa.array(p[1]),
                lists(keys.T[there].view(np.int64), depth, pa.int64())]))
        return _structs(parts, _WINDOW)

    texts = pages.select(*_named(url), url.alias("url")).filter("url is not null").dropDuplicates(["ua", "ub"])
    windows = written(texts.select("ua", "ub", F.explode(split("url")).alias("v")).select("ua", "ub", "v.*"), "windows")
    once = windows.select("w", "byte", "p0", "p1", "ctxs").dropDuplicates(["w"])
    tried = once.select("w", "byte", F.posexplode("ctxs").alias("back", "ctx"))
    heads = model.select("ctx", "n0", "n1", "k0", "k1", F.map_from_entries(F.transform(
        "next", lambda e: F.struct(e.byte, e))).alias("after"))
    x = F.element_at("after", F.col("byte"))
    met = salted_join(tried, heads, ["ctx"]).select("w", F.struct(
        "back", "n0", "n1", "k0", "k1", *[F.coalesce(x[n], F.lit(0)).alias(f"x{n}") for n in ("n0", "n1")]).alias("m"))
    met = met.groupBy("w").agg(F.array_sort(F.collect_list("m")).alias("met"))

    def chance(side: int):
        n, k = f"n{side}", f"k{side}"
        return F.log(F.aggregate(F.coalesce("met", F.array().cast(met.schema["met"].dataType)), F.col(f"p{side}"),
                                 lambda p, m: F.when(m[n] > 0, (m[f"x{n}"] + m[k] * p) / (m[n] + m[k])).otherwise(p)))

    ratio = once.join(met, "w", "left").select("w", (chance(1) - chance(0)).alias("ratio"))
    scored = salted_join(windows.select("ua", "ub", "w"), ratio, ["w"])
    return scored.groupBy("ua", "ub").agg(F.round(F.avg("ratio"), 9).alias("score"))


def _named(url: Column) -> list[Column]:
    return [F.xxhash64(url).alias("ua"), F.xxhash64(F.lit(1), url).alias("ub")]


def judge(pages: DataFrame, rules: dict[str, str], url_col: str = "url",
          held: Column | None = None) -> DataFrame:
    """`pages` with host, path, rule, verdict and score. `rules` maps host/path to allow or block.

    `held` marks the decided URLs kept for calibration, by default a quarter by hash of the URL.
    """
    host, path = host_and_path(F.col(url_col))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"host": host, "path": path}).withColumn("rule", rule)
    named = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    by_rule = F.when(F.col("rule").isNotNull(), named[F.col("rule")])
    held = F.pmod(F.xxhash64(F.lower(url_col)), F.lit(4)) == 3 if held is None else held
    decided = pages.select(F.col(url_col).alias("url"), (by_rule == "allow").alias("accepted"),
                           held.alias("held")).filter("accepted is not null")
    known = decided.filter("not held")
    # equal URLs and common contexts are summed where they lie
    counted = (known.select("accepted", F.explode(_contexts("url")).alias("code"))
               .groupBy("accepted", "code").agg(F.count(F.lit(1)).alias("n")))
    base, both = class_logs(written(counted, "classes"))
    model = contexts(known)
    own = byte_logs(model)
    if (model.agg(F.sum(F.size("next"))).first()[0] or 0) <= SMALL_MODEL:
        score = _by_broadcast(model, base, own)
        scored = pages.withColumn("score", score(F.col(url_col)))
        held_scores = decided.filter("held").select("accepted", score("url").alias("score"))
    else:
        scores = written(_by_join(pages, F.col(url_col), model, base, own), "scores")

        def with_score(rows: DataFrame, url: Column) -> DataFrame:
            keys = {f"__{c}": k for c, k in zip(("ua", "ub"), _named(url))}
            named = scores.withColumnsRenamed({"ua": "__ua", "ub": "__ub"})
            found = salted_join(rows.withColumns(keys), named, list(keys), "left").drop(*keys)
            return found.withColumn("score", F.coalesce("score", F.lit(0.0)))

        scored = with_score(pages.drop("score"), F.col(url_col))
        held_scores = with_score(decided.filter("held"), F.col("url")).select("accepted", "score")
    cutoff = _cutoff(held_scores) if both else None
    guessed = F.when(F.col("score") >= F.lit(cutoff), "allow").otherwise("block") if both else F.lit("allow")
    return scored.withColumn("verdict", F.coalesce(by_rule, guessed))


def _cutoff(held: DataFrame) -> float:
    """Where accepted and rejected held-out URLs part best: the mean of the two error rates is
    least, the middle of the best stretch. Scores are counted in bins, at most 2 * REACH + 1."""
    bins = F.greatest(F.least(F.floor(F.col("score") * STEP), F.lit(REACH)), F.lit(-REACH))
    rows = held.groupBy("accepted", bins.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    seen = np.zeros((2, 2 * REACH + 1), np.int64)
    for row in rows.collect():
        seen[int(row["accepted"]), row["bin"] + REACH] = row["n"]
    if not seen[0].any() or not seen[1].any():
        return 0.0
    # with the cutoff at the lower border of bin i, bins below i are rejected
    lost = np.concatenate([[0], np.cumsum(seen[1])]) / seen[1].sum()
    passed = 1 - np.concatenate([[0], np.cumsum(seen[0])]) / seen[0].sum()
    best = np.flatnonzero(lost + passed <= (lost + passed).min() + 1e-12)
    return float((best[0] + best[-1]) / 2 - REACH) / STEP
