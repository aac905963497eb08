"""Quality rules whose cutoffs are chosen under a guarantee on false rejections.

Every text gets its counts in one pass. Labelled documents of good quality decide, in each stratum on
their own. A quarter of them (by hash of the id) draws one nested sequence of steps along which the
cutoffs of all features tighten together: from far above the highest value seen, in units of its
distance from the median, down to it, then along common quantiles. The others test it: from the
loosest step on, an exact binomial test must show that all features together reject at most a stated
share of good documents; the last step before the first failure is taken. Such a fixed sequence needs
no correction for its steps, only for the strata (Bonferroni). A stratum with fewer than
ln(level / strata) / ln(1 - share) testing documents gets no cutoff and loses no document by the method.

NULL and empty texts have no words and fail the base rule. NULL strata form a stratum. Labels may
repeat; a document counts as good if no label of it says otherwise. Repeated documents, ties and
further columns change nothing: decisions depend on the text and the stratum alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import mixed, per_row, pieces, vectorized, written
from wayfare.llm.words import LINES, SPACED, scan, windows

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
# what a rule looks at, as a whole number from 0 to TOP; a document is rejected above the cutoff
TOP = 200
FEATURES = {
    "symbols_per_mille": ("n_symbols", 1000, "word_chars"),
    "dup_lines_percent": ("n_dup_lines", 100, "n_lines"),
    "repeat_words_percent": ("n_repeat_words", 100, "n_words"),
    "mean_word_tenths": ("word_chars", 10, "n_words"),
}
FALSE_REJECTIONS = 0.02  # of good documents of a stratum, all features together
CONFIDENCE = 0.95
DRAWING = 4  # one good document in so many draws the sequence instead of testing it
_KIND = pa.struct([(name, pa.int64()) for name in COUNTS])


def _again(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (row, hash) pairs: whether one occurs twice or more, and whether it came before."""
    _, first, back, counts = np.unique(
        hashes ^ mixed(rows.astype(np.uint64) + np.uint64(1)),
        return_index=True, return_inverse=True, return_counts=True,
    )
    later = np.ones(len(hashes), bool)
    later[first] = False
    return counts[back] > 1, later


def _count(data: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    words = scan(data, borders, SPACED)
    in_word = SPACED[data] != 0
    marks = np.zeros(256, bool)
    marks[list(SYMBOLS)] = True
    lines = scan(data, borders, LINES)
    total = np.concatenate([[0], np.cumsum(in_word)])
    full = total[lines.ends] > total[lines.starts]
    rows = lines.rows[full]
    _, later = _again(rows, lines.hashes[full])
    first, hashes = windows(words, 3)
    twice, _ = _again(words.rows[first], hashes)
    hit = np.zeros(len(words.starts), bool)
    for j in range(3):
        hit[first[twice] + j] = True
    n = len(borders) - 1
    return [
        words.counts,
        per_row(in_word & ((data & 0xC0) != 0x80), borders),
        per_row(marks[data], borders),
        np.bincount(rows, minlength=n),
        np.bincount(rows[later], minlength=n),
        np.bincount(words.rows[hit], minlength=n),
    ]


@vectorized(", ".join(f"{name} long" for name in COUNTS))
def text_counts(text: pa.Array) -> pa.Array:
    """Counts of words, their characters, symbols, lines, repeated lines and repeated words."""
    parts = [_count(*piece) for piece in pieces(text)]
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)
               for i in range(len(COUNTS))]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_KIND))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature(name: str) -> Column:
    part, scale, whole = FEATURES[name]
    ratio = F.floor(F.col(part) * scale / F.col(whole))
    return F.when(F.col(whole) > 0, F.least(ratio, F.lit(TOP))).otherwise(0).cast("int")


def binomial_at_most(x: int, n: int, p: float) -> float:
    """P(X <= x) for X ~ Binomial(n, p). Terms are summed from the largest downwards."""
    if x >= n:
        return 1.0
    if x >= n * p:  # not needed exactly: far above any level of a test
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1)
                    + x * math.log(p) + (n - x) * math.log1p(-p))
    total, k = 0.0, x
    while term > 0 and (term > total * 1e-17):
        total += term
        if k == 0:
            break
        term *= k / (n - k + 1) * (1 - p) / p
        k -= 1
    return total


def tightest(rejected_above: list[int], good: int, share: float, level: float) -> int | None:
    """The lowest cutoff whose false rejections are shown to be at most `share` at `level`."""
    found = None
    for cutoff in range(len(rejected_above) - 1, -1, -1):
        if good and binomial_at_most(rejected_above[cutoff], good, share) <= level:
            found = cutoff
        else:
            break
    return found


def _positions(bins: pd.DataFrame, name: str) -> np.ndarray:
    """Per value of a feature, the step from which on it is rejected; steps go downwards.

    A value within those seen has minus the number of documents that reach it, one above them its
    distance in sixteenths of that between the highest and the median.
    """
    seen = np.zeros(TOP + 1, np.int64)
    part = bins[bins["feature"] == name]
    seen[part["value"].to_numpy()] = part["rows"].to_numpy()
    highest = int(np.flatnonzero(seen)[-1])
    median = int(np.searchsorted(np.cumsum(seen), (seen.sum() + 1) // 2))
    beyond = 16 * (np.arange(TOP + 1) - highest) // (highest - median + 1)
    return np.where(np.arange(TOP + 1) > highest, beyond, -np.cumsum(seen[::-1])[::-1])


def cutoffs(counts: DataFrame, labels: DataFrame, id_col: str, stratum: str,
            share: float = FALSE_REJECTIONS, confidence: float = CONFIDENCE,
            label_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """One row per stratum with a cutoff per feature, NULL where none is safe.

    `counts` has the columns of `text_counts`. Only histograms of labelled documents meet: at
    most TOP + 1 rows per stratum and feature of those that draw, and of steps of those that test.
    """
    good = (labels.groupBy(F.col(label_id).alias("label_id")).agg(F.min(quality).alias("good"))
            .filter("good = 1"))
    held = counts.filter(~base_failed()).join(good, F.col(id_col) == F.col("label_id"), "left_semi")
    held = held.groupBy(
        F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("stratum"),
        (F.pmod(F.xxhash64(F.col(id_col)), F.lit(DRAWING)) == 0).alias("draws"),
        *[feature(n).alias(n) for n in FEATURES],
    ).agg(F.count(F.lit(1)).alias("rows"))
    held = written(held, "held")
    strata = held.select("stratum").distinct().count()
    level = (1 - confidence) / max(1, strata)
    bins = held.filter("draws").select("stratum", "rows", F.explode(F.array(
        *[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in FEATURES])).alias("f"))
    bins = written(bins.groupBy("stratum", "f.feature", "f.value").agg(F.sum("rows").alias("rows")), "bins")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {f"at_{n}": _positions(pdf, n) for n in FEATURES}
        return pd.DataFrame([{"of": pdf["stratum"].iloc[0]} | row])

    places = written(bins.groupBy("stratum").applyInPandas(
        place, "of string, " + ", ".join(f"at_{n} array<long>" for n in FEATURES)), "places")
    if places.count() <= SMALL_PLACES:
        places = F.broadcast(places)
    first = F.greatest(*[F.element_at(f"at_{n}", F.col(n) + 1) for n in FEATURES])
    steps = (held.filter("not draws").join(places, F.col("stratum") == F.col("of"))
             .groupBy("stratum", first.alias("step")).agg(F.sum("rows").alias("rows")))

    def choose(bins: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        row = {"stratum": bins["stratum"].iloc[0], **dict.fromkeys(FEATURES)}
        steps = steps.sort_values("step")
        rows = steps["rows"].to_numpy()
        # the step above each position rejects the documents at higher ones
        above = rows.sum() - np.cumsum(rows)
        found = tightest(above.tolist(), int(rows.sum()), share, level)
        if found is not None:
            last = int(steps["step"].iloc[found]) + 1
            row |= {n: int((_positions(bins, n) < last).sum()) - 1 for n in FEATURES}
        return pd.DataFrame([row]).astype({name: "Int32" for name in FEATURES})

    schema = "stratum string, " + ", ".join(f"{n} int" for n in FEATURES)
    return bins.groupBy("stratum").cogroup(steps.groupBy("stratum")).applyInPandas(choose, schema)


SMALL_STRATA = 10_000  # rows of cutoffs that are broadcast; more are joined by shuffle
SMALL_PLACES = 1_000  # the same of rows that hold a stratum's steps, some 6 KB each


def judged(counts: DataFrame, limits: DataFrame, stratum: str) -> DataFrame:
    """`counts` with base_failed and kept."""
    limits = written(limits, "cutoffs")
    names = {n: f"limit_{n}" for n in FEATURES}
    limits = limits.select(F.col("stratum").alias("limit_stratum"),
                           *[F.col(n).alias(a) for n, a in names.items()])
    if limits.count() <= SMALL_STRATA:
        limits = F.broadcast(limits)
    same = F.coalesce(F.col(stratum).cast("string"), F.lit("\0")) == F.col("limit_stratum")
    passed = F.lit(True)
    for name, limit in names.items():
        passed = passed & F.coalesce(feature(name) <= F.col(limit), F.lit(True))
    return (counts.withColumn("base_failed", base_failed()).join(limits, same, "left")
            .withColumn("kept", ~F.col("base_failed") & passed)
            .drop("limit_stratum", *names.values()))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", stratum: str = "lang", **risk) -> DataFrame:
    """One row per document: id, stratum, counts, base_failed and kept.

    The counts are written once; neither they nor the decisions carry the text.
    """
    counts = docs.select(id_col, stratum, text_counts(F.col(text_col)).alias("c"))
    counts = written(counts.select(id_col, stratum, "c.*"), "counts")
    return judged(counts, cutoffs(counts, labels, id_col, stratum, **risk), stratum)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
              text_col: str = "text", stratum: str = "lang", **risk) -> DataFrame:
    """The documents that the rules keep, with their columns. Texts are not shuffled: the second
    pass counts again where they lie."""
    columns = docs.columns
    counts = docs.select(id_col, stratum, text_counts(F.col(text_col)).alias("c"))
    counts = written(counts.select(id_col, stratum, "c.*"), "counts")
    limits = cutoffs(counts, labels, id_col, stratum, **risk)
    packed = docs.select(F.struct(*columns).alias("doc"), F.col(stratum).alias("doc_stratum"),
                         text_counts(F.col(text_col)).alias("c"))
    flat = packed.select("doc", "doc_stratum", "c.*")
    return judged(flat, limits, "doc_stratum").filter("kept").select("doc.*")
