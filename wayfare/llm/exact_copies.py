"""Exact copies by a tree of merged digest runs.

Every input partition is a run: its rows' digests, one entry a digest, with the smallest id and the
number of rows. In every round FAN_IN neighbouring runs are merged into one, until one is left; an
entry is dealt by run and digest, so the tasks of a round hold sorted parts of merged runs and share
them evenly. A digest that fills a third of the table is one entry per run before the first shuffle
and at most FAN_IN entries afterwards. The answers go down the same tree: an entry answers the at
most FAN_IN entries it came from, and those the rows of one partition. Entries of one row need no
answer. All steps are DataFrame operations.

Texts are equal when identical after each run of space, \\t, \\n, \\v, \\f and \\r became one space. An
entry is named by SHA-256, verified at every level by the length and a second hash of the text. NULL
is the empty text. The smallest id stays, NULL ids come last, and of rows equal in id and text the
first in table order stays. Every row gets an answer; an empty table gives an empty one. Only the id
and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import written

FAN_BITS = 4  # 2^4 runs are merged into one in a round
SPACES = r"[\x20\x09-\x0D]+"

KEY = ["digest", "size", "check"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, run, digest, size, check) per row; `row` orders the table, `run` is its partition."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    row = F.monotonically_increasing_id()  # partition number in the bits from 33 on
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"), row.alias("row"))
    return named.select(
        "id", "row", F.shiftright("row", 33).alias("run"),
        F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"),
        F.xxhash64("text").alias("check"))


def merged(runs: DataFrame, bits: int) -> DataFrame:
    """One round: 2^bits neighbouring runs become one, entries of equal texts become one."""
    return runs.withColumn("run", F.shiftright("run", bits)).groupBy("run", *KEY).agg(
        F.min("first").alias("first"), F.sum("n").alias("n"))


def handed_down(answers: DataFrame, runs: DataFrame, bits: int) -> DataFrame:
    """The answers of a level for the entries of the level below."""
    entries = runs.select("run", *KEY, F.shiftright("run", bits).alias("above"))
    return entries.join(answers.withColumnRenamed("run", "above"), ["above", *KEY]).drop("above")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 fan_bits: int = FAN_BITS) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row of `docs`, whole groups of equal texts."""
    rows = written(digest_rows(docs, id_col, text_col), "digests")
    first = F.struct(F.col("id").isNull().alias("nameless"), "id", "row")
    single = rows.select("run", *KEY, first.alias("first"), F.lit(1).cast("long").alias("n"))
    levels = [written(merged(single, 0), "runs")]
    last = rows.agg(F.max("run")).first()[0] or 0
    while last:
        levels.append(written(merged(levels[-1], fan_bits), "runs"))
        last >>= fan_bits
    answers = levels.pop().filter("n > 1")
    while levels:
        answers = handed_down(answers, levels.pop(), fan_bits)
    told = rows.join(answers, ["run", *KEY], "left")
    lone = F.col("n").isNull()
    return told.select(
        "id", F.when(lone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (lone | (F.col("first.row") == F.col("row"))).alias("kept"), "digest")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns; of rows equal in id and text any one stays."""
    found = exact_copies(docs, id_col, text_col).filter("kept")
    stay = found.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    named = docs.withColumn("__own", F.unhex(F.sha2(text, 256)))
    same = named["__own"].eqNullSafe(F.col("__digest")) & named[id_col].eqNullSafe(F.col("__id"))
    return named.join(stay, same, "left_semi").dropDuplicates(["__own"]).drop("__own")
