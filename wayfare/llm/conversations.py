"""Prefix trie of conversations, built as z-fast tries and merged by Spark.

A conversation is a sequence of turns; the id of a prefix is a 128-bit hash chained over its turns, so
equal ids are equal prefixes. Equal sequences are combined before anything else, which leaves one
row however often a conversation is repeated. The distinct sequences are dealt by ranges, about
TASK_TURNS turns to a task, so that those with common prefixes meet and a common first turn
still spreads over many tasks. Each task builds a z-fast trie: nodes are compacted, a hash table
holds each at its handle, the two-fattest depth of its edge; a sequence finds the deepest node on its
path by fat binary search, one lookup per halving of the depth; every Arrow batch is first located
in the trie as it stands and then inserted, splitting edges. Finished tries are expanded to one row
per prefix.

Tries of different tasks share only prefixes at borders of ranges. Rows are merged by prefix id, which
gives exact counts. Sums over subtrees that lie in one task are that task's; those of the few shared
prefixes are added up along the shared part alone, by doubling the distance in every round.

NULL turns come first; turns of equal number are ordered by their digest, role and text together. NULL
roles and texts are empty. Rows without a conversation id belong to no conversation. A conversation
without turns is a member of the root. An empty table has no node. One conversation, like one
text, fits a task; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import vectorized, written
from wayfare.operators.skew import salted_join

TASK_TURNS = 200_000
ROOT = bytes(16)


def turn_lists(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """(conv_id, steps): the turns of every conversation in order, as (turn, mark, bytes)."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    step = F.struct(F.col(turn).alias("turn"), F.unhex(F.md5(whole)).alias("mark"),
                    F.octet_length(text).cast("long").alias("bytes"))
    named = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), step.alias("step"))
    return named.groupBy("conv_id").agg(F.sort_array(F.collect_list("step")).alias("steps"))


@vectorized("array<binary>")
def prefix_ids(marks: pa.Array) -> pa.Array:
    """The id of every prefix of a sequence of turns, the empty one left out."""
    out = []
    for row in marks.to_pylist():
        now, path = ROOT, []
        for mark in row:
            now = hashlib.blake2b(now + mark, digest_size=16).digest()
            path.append(now)
        out.append(path)
    return pa.array(out, pa.list_(pa.binary()))


def sequences(lists: DataFrame) -> DataFrame:
    """(conv_id, path, sizes, end) per conversation: prefix ids, text bytes, and its last prefix id."""
    named = lists.select("conv_id", prefix_ids(F.col("steps.mark")).alias("path"),
                         F.col("steps.bytes").alias("sizes"))
    end = F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(ROOT))
    return named.withColumn("end", end)


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """A compacted trie of sequences of prefix ids; node 0 is the root.

    The edge into node v holds depths low[v] + 1 to high[v] of path[v].
    """

    def __init__(self):
        self.low, self.high, self.up = [0], [0], [0]
        self.path, self.sizes = [[]], [[]]
        self.ending, self.least = [0], [None]
        self.handles: dict[bytes, int] = {}
        self.edges: dict[bytes, int] = {}

    def locate(self, path: list[bytes], at: int = 0) -> int:
        """The deepest node that is a prefix of `path`, by fat binary search below node `at`."""
        low, high = self.high[at], len(path)
        while low < high:
            fattest = two_fattest(low, high)
            node = self.handles.get(path[fattest - 1])
            if node is None:
                high = fattest - 1
                continue
            depth = self.high[node]
            if depth > len(path) or self.path[node][depth - 1] != path[depth - 1]:
                return self.up[node]  # the path leaves within this edge
            low, at = depth, node
        return at

    def insert_batch(self, batch: list[tuple[list[bytes], list[int], int, object]]) -> None:
        """Insert (path, sizes, number, least) rows: all are located, then added in order of paths."""
        found = [self.locate(row[0]) for row in batch]
        for i in sorted(range(len(batch)), key=lambda i: batch[i][0]):
            path, sizes, n, least = batch[i]
            node = self._place(path, sizes, found[i])
            self.ending[node] += n
            self.least[node] = _least(self.least[node], least)

    def _place(self, path: list[bytes], sizes: list[int], near: int) -> int:
        at = self.locate(path, near)
        depth = self.high[at]
        if depth == len(path):
            return at
        child = self.edges.get(path[depth])
        if child is not None:
            low, high, other = depth + 1, min(len(path), self.high[child]), self.path[child]
            while low < high:  # the deepest common prefix; ids agree up to it and never after
                middle = (low + high + 1) // 2
                low, high = (middle, high) if other[middle - 1] == path[middle - 1] else (low, middle - 1)
            at = self._split(child, low)
        return at if self.high[at] == len(path) else self._add(at, len(path), path, sizes)

    def _add(self, up: int, high: int, path: list[bytes], sizes: list[int]) -> int:
        node = len(self.low)
        for values, value in ((self.low, self.high[up]), (self.high, high), (self.up, up), (self.path, path),
                              (self.sizes, sizes), (self.ending, 0), (self.least, None)):
            values.append(value)
        self._hang(node)
        return node

    def _hang(self, node: int) -> None:
        path, low = self.path[node], self.low[node]
        self.handles[path[two_fattest(low, self.high[node]) - 1]] = node
        self.edges[path[low]] = node

    def _split(self, child: int, depth: int) -> int:
        node = self._add(self.up[child], depth, self.path[child], self.sizes[child])
        self.low[child], self.up[child] = depth, node
        self._hang(child)
        return node

    def expanded(self) -> Iterator[tuple]:
        """A row per prefix: id, depth, parent, bytes, n, least, parent's least, and over the subtree
        leaves and saved bytes."""
        n, least = list(self.ending), list(self.least)
        leaves, saved = [0] * len(n), [0] * len(n)
        order = sorted(range(1, len(n)), key=self.high.__getitem__, reverse=True)
        for node in order:  # children come before their parent
            up = self.up[node]
            leaves[node] = leaves[node] or 1
            span = sum(self.sizes[node][self.low[node]:self.high[node]])
            n[up] += n[node]
            least[up] = _least(least[up], least[node])
            leaves[up] += leaves[node]
            saved[up] += saved[node] + (n[node] - 1) * span
        if n[0]:
            yield ROOT, 0, None, 0, n[0], least[0], None, leaves[0] or 1, saved[0]
        for node in order:
            path, sizes, total = self.path[node], self.sizes[node], saved[node]
            for depth in range(self.high[node], self.low[node], -1):
                total += (n[node] - 1) * sizes[depth - 1]
                top = depth == self.low[node] + 1
                yield (path[depth - 1], depth, path[depth - 2] if depth > 1 else ROOT, sizes[depth - 1], n[node],
                       least[node], least[self.up[node]] if top else least[node], leaves[node], total)


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _tries(kind: str):
    """Arrow batches of distinct sequences of one task to the expanded rows of their trie."""
    schema = (f"id binary, depth long, parent binary, bytes long, n long, least {kind}, parent_least {kind}, "
              "leaves long, saved long")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, types = ZFastTrie(), [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), None, None,
                                    pa.int64(), pa.int64()]
        for batch in batches:
            types[5] = types[6] = batch.schema.field("least").type
            trie.insert_batch(list(zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "n", "least")))))
        rows: list[tuple] = []
        for row in trie.expanded():
            rows.append(row)
            if len(rows) == 20_000:
                yield _batch(rows, types, names)
                rows = []
        if rows:
            yield _batch(rows, types, names)

    return run, schema


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _shared_sums(shared: DataFrame) -> DataFrame:
    """(id, leaves, saved) summed over the shared descendants of every shared prefix.

    After round k a prefix has the sums of its descendants nearer than 2^k, and knows its ancestor
    at that distance.
    """
    now = written(shared.select("id", F.col("parent").alias("up"), "leaves", "saved"), "sums")
    while not now.filter("up IS NOT NULL").isEmpty():
        added = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        farther = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        now = written(now.join(added, "id", "left").join(farther, "up", "left").select(
            "id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "sums")
    return now.drop("up")


def prefix_trie(paths: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """One row per distinct prefix of the sequences of `sequences`, the root included.

    (id, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens): conv_id is
    the smallest member, n_leaves and saved_tokens cover the subtree.
    """
    kind = dict(paths.dtypes)["conv_id"]
    distinct = written(paths.groupBy("end").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("path").alias("path"),
        F.first("sizes").alias("sizes")).drop("end"), "sequences")
    turns = distinct.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    run, schema = _tries(kind)
    local = distinct.repartitionByRange(max(1, -(-turns // task_turns)), "path").mapInArrow(run, schema)
    nodes = written(local.groupBy("id").agg(
        F.count(F.lit(1)).alias("parts"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        F.first("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("least").alias("least"),
        F.min("parent_least").alias("parent_least"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")),
        "prefixes")
    alone = F.col("parts") == 1

    def of_one_task(column: str) -> Column:
        return F.sum(F.when(alone, F.col(column)).otherwise(0))

    below = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("n_children"), of_one_task("leaves").alias("leaves_below"),
        of_one_task("saved").alias("saved_below"))
    own_saved = (F.col("n") - 1) * F.col("bytes") + F.coalesce("saved_below", F.lit(0))
    own_leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("leaves_below", F.lit(0)))
    counted = written(nodes.join(below, "id", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))).withColumns({
            "leaves": F.when(alone, F.col("leaves")).otherwise(own_leaves),
            "saved": F.when(alone, F.col("saved")).otherwise(own_saved)}).drop("leaves_below", "saved_below"),
        "counted")
    shared = counted.filter(~alone)
    if not shared.isEmpty():
        sums = _shared_sums(shared)
        whole = shared.drop("leaves", "saved").join(sums, "id").select(*counted.columns)
        counted = written(counted.filter(alone).unionByName(whole), "summed")
        smallest = shared.select(F.col("id").alias("parent"), F.col("least").alias("shared_least"))
        counted = salted_join(counted, smallest, ["parent"], "left").withColumn(
            "parent_least", F.coalesce("shared_least", "parent_least"))
    return counted.select(
        "id", "parent", "depth", F.col("least").alias("conv_id"), F.col("parent_least").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"))


def end_digests(paths: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the ids, ascending and comma-joined, of the conversations that end at a prefix.

    The hash is one chain, so the ids that end at one prefix pass one task, sorted, as a stream of batches
    of which no more than one is held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for now, conv in zip(batch.column("end").to_pylist(), batch.column("conv").to_pylist()):
                if now == end:
                    digest.update(b"," + conv.encode())
                    continue
                if end is not None:
                    done.append((end, digest.hexdigest()))
                end, digest = now, hashlib.sha256(conv.encode())
            if done:
                yield _batch(done, [pa.binary(), pa.string()], ["id", "ends_sha256"])
        if end is not None:
            yield _batch([(end, digest.hexdigest())], [pa.binary(), pa.string()], ["id", "ends_sha256"])

    sorted_rows = paths.select("end", "conv_id").repartition("end").sortWithinPartitions("end", "conv_id")
    return sorted_rows.select("end", F.col("conv_id").cast("string").alias("conv")).mapInArrow(
        run, "id binary, ends_sha256 string")
