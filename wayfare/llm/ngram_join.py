"""Self-join of texts by the Jaccard similarity of their word n-grams, by a MinHash LSH forest.

1. A text is its set of five-word shingles (a shorter text: one shingle of all its words). Equal
   sets are one node; copies are counted, never paired.
2. Each tree of the forest is a prefix trie of MinHash values; nodes below one prefix are
   candidates. Tries are tables of (node, prefix), one level at a time. In every trie a node stands
   at the shortest prefix of STEPS lengths that is not crowded, that is, shared by at most `bucket_rows`
   nodes. The first length is the greatest at which `trees` trees reach the target recall.
3. The recall of a node follows from where it stands: the chance that a set of the threshold's
   similarity leaves its prefix in every trie. A node that lacks recall, because its prefixes had to be
   long, joins as many more trees as make up for it; all others are done, and their crowded prefixes are
   dropped. A pair is met with the target recall in the trees of the one of it that joined fewer.
4. Prefixes that are crowded at the last length are compared in tiles; no node is left out.
5. Candidates are compared by a sketch of one byte per MinHash value, with a margin of several
   standard deviations, which leaves groups of texts that are probably alike.
6. In each such group all pairs are verified exactly on the shingle sets. Large groups are verified
   tile by tile; tiles give back counts and a spanning forest, never pairs.

The result has one row per document: class_id is the smallest id among all documents connected by
links, n_links the number of other documents at or above the threshold, copies included. NULL
and wordless texts have no shingles, hence no links, and are classes of their own. Repeated rows
are copies. A NULL id is a document, too; a class with one has the NULL id if it sorts first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import lists, mixed, pieces, random_words, row_key, vectorized, written
from wayfare.llm.components import components
from wayfare.llm.grouped import by_group, labels, tiles
from wayfare.llm.words import SPACED, scan, windows
from wayfare.operators.skew import GROUP_ROWS, salted_join, salts_of

WORDS = 5
THRESHOLD = 0.8
TREES = 24
DEEPEST = 8  # longest prefix that all nodes start from
STEPS = (1, 2, 3)  # prefix lengths, as multiples of the first
RECALL = 0.99999
MARGIN = 4.5  # standard deviations between the threshold and what a sketch must show
BUCKET_ROWS = 1024  # nodes below a prefix that is not crowded; one tile of a crowded one
BLOCK_ROWS = 512  # nodes, and
BLOCK_SHINGLES = 250_000  # shingles of a verified block


def recall(depth: int, trees: int, similarity: float) -> float:
    """Chance that two sets share a prefix of `depth` values in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(trees: int, similarity: float, target: float, deepest: int = DEEPEST) -> int:
    """The longest prefix that reaches the target recall."""
    for depth in range(deepest, 0, -1):
        if recall(depth, trees, similarity) >= target:
            return depth
    raise ValueError("more trees are needed for this recall")


def log_miss(depth: int, similarity: float) -> float:
    """Logarithm of the chance that two sets part within `depth` values of one tree."""
    return math.log(max(1 - similarity**depth, 1e-300))


def trees_for(depth: int, similarity: float, target: float) -> int:
    """Trees that reach the target recall with prefixes of this length alone."""
    return math.ceil(math.log(1 - target) / log_miss(depth, similarity))


def sketch_matches(values: int, similarity: float, margin: float = MARGIN) -> int:
    """Equal bytes of `values` that two sets of this similarity have, less the margin."""
    equal = similarity + (1 - similarity) / 256
    return int(np.floor(values * (equal - margin * np.sqrt(equal * (1 - equal) / values))))


def shingles(data: np.ndarray, borders: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles of each row, in the order of rows."""
    words = scan(data, borders, SPACED)
    first, hashes = windows(words, k)
    rows = [words.rows[first]]
    found = [hashes]
    for short in range(1, k):
        first, hashes = windows(words, short)
        whole = words.counts[words.rows[first]] == short
        rows.append(words.rows[first][whole])
        found.append(hashes[whole])
    row, found = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return row[fresh], found[fresh]


def _least(row: np.ndarray, hashes: np.ndarray, rows: int, trees: int, depth: int):
    """Rows with shingles, where theirs start, and `depth` MinHash values in each of `trees` trees.

    A value depends on its tree and its place in the path alone, so a longer path goes on from a shorter.
    """
    counts = np.bincount(row, minlength=rows)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    least = np.zeros((rows, trees, depth), np.uint32)
    for place in range(depth if len(full) else 0):
        salts, odd = random_words(trees, 31 + 4 * place), random_words(trees, 33 + 4 * place)
        for tree in range(trees):
            least[full, tree, place] = np.minimum.reduceat(
                (((hashes ^ salts[tree]) * odd[tree]) >> np.uint64(32)).astype(np.uint32), starts)
    return counts, full, starts, least


def _prefixes(least: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's whole path in each tree."""
    rows, trees, depth = least.shape
    keys = np.zeros((rows, trees), np.uint64)
    for place in range(depth):
        keys = mixed(keys + least[:, :, place] + np.arange(1, trees + 1, dtype=np.uint64)
                     * np.uint64(0x9E3779B97F4A7C15))
    return keys


def signature_column(k: int, trees: int, depth: int):
    """Per text: the name of its shingle set, its size, the key of its prefix in each tree, a sketch."""
    kind = pa.struct([("node", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())),
                      ("sketch", pa.binary())])

    @vectorized("struct<node:binary,n:int,keys:array<bigint>,sketch:binary>")
    def sign(text: pa.Array) -> pa.Array:
        out = []
        for data, borders in pieces(text):
            rows = len(borders) - 1
            row, hashes = shingles(data, borders, k)
            counts, full, starts, least = _least(row, hashes, rows, trees, depth)
            names = np.zeros((rows, 2), np.uint64)
            if len(full):
                names[full, 0] = np.add.reduceat(mixed(hashes), starts)
                names[full, 1] = np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
            keys = _prefixes(least)
            names[:, 0] += counts.astype(np.uint64)  # sets of different size differ
            node, marks = names.tobytes(), (least & 0xFF).astype(np.uint8).tobytes()
            width = trees * depth
            out.append((
                [node[16 * i:16 * i + 16] for i in range(rows)], counts, keys.view(np.int64).ravel(),
                np.full(rows, trees), [marks[width * i:width * (i + 1)] for i in range(rows)]))
        if not out:
            return pa.array([], kind)
        return pa.StructArray.from_arrays(
            [pa.array([x for o in out for x in o[0]], pa.binary()),
             pa.array(np.concatenate([o[1] for o in out]), pa.int32()),
             lists(np.concatenate([o[2] for o in out]), np.concatenate([o[3] for o in out]), pa.int64()),
             pa.array([x for o in out for x in o[4]], pa.binary())], fields=list(kind))

    return sign


def path_column(k: int, trees: int, depth: int):
    """Per text: the key of its prefix of `depth` values in each of `trees` trees."""
    @vectorized("array<bigint>")
    def sign(text: pa.Array) -> pa.Array:
        values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data, borders in pieces(text):
            rows = len(borders) - 1
            row, hashes = shingles(data, borders, k)
            values.append(_prefixes(_least(row, hashes, rows, trees, depth)[3]).view(np.int64).ravel())
            counts.append(np.full(rows, trees))
        return lists(np.concatenate(values), np.concatenate(counts), pa.int64())

    return sign


def set_column(k: int):
    @vectorized("array<bigint>")
    def find(text: pa.Array) -> pa.Array:
        values, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data, borders in pieces(text):
            row, hashes = shingles(data, borders, k)
            values.append(hashes.view(np.int64))
            counts.append(np.bincount(row, minlength=len(borders) - 1))
        return lists(np.concatenate(values), np.concatenate(counts), pa.int64())

    return find


def _matching(table: pa.Table, borders: np.ndarray, enough: int) -> pa.Table | None:
    """Spanning edges of the rows of each bucket whose sketches agree in `enough` bytes."""
    n = len(table)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
    group = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    own, x, y = (table.column(c).to_numpy() for c in ("own", "x", "y"))
    across = x != y
    a, b = [], []
    for apart in range(1, int(np.diff(borders).max())):
        i = np.flatnonzero(group[apart:] == group[:-apart])
        i = i[~across[i] | (own[i] != own[i + apart])]
        for some in np.array_split(i, max(1, len(i) // 100_000)):
            alike = some[(sketch[some] == sketch[some + apart]).sum(1) >= enough]
            a.append(alike)
            b.append(alike + apart)
    if not a:
        return None
    label = labels(n, np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(label != np.arange(n))
    node = table.column("node").combine_chunks()
    return pa.table({"a": node.take(pa.array(moved)), "b": node.take(pa.array(label[moved]))})


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    common = counts[column] > 1
    place = np.cumsum(counts > 1) - 1
    row, column = row[common], place[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, width = np.zeros((n, n), np.float32), 2048
    for begin in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], column[lo:hi] - begin] = 1
        total += part @ part.T
    return np.round(total).astype(np.int64)


def _verified(table: pa.Table, borders: np.ndarray, threshold: float) -> pa.Table | None:
    """Per row: the weight of its links within the tile and the root of its tree of links."""
    node = table.column("node").to_pylist()
    weight, own, x, y = (table.column(c).to_numpy() for c in ("w", "own", "x", "y"))
    sets = [s.values.to_numpy() for s in table.column("shingles").combine_chunks()]
    out_node, out_links, out_root = [], [], []
    for begin, end in zip(borders[:-1].tolist(), borders[1:].tolist()):
        # an equal row of the table brings its node again
        rows = list({node[i]: i for i in range(begin, end)}.values())
        if len(rows) < 2:
            continue
        sizes = np.array([len(sets[i]) for i in rows])
        shared = _shared([sets[i] for i in rows])
        union = sizes[:, None] + sizes[None, :] - shared
        linked = shared >= threshold * union - 1e-9
        np.fill_diagonal(linked, False)
        if x[begin] != y[begin]:
            linked &= own[rows][:, None] != own[rows][None, :]
        links = linked @ weight[rows]
        label = labels(len(rows), *np.nonzero(np.triu(linked)))
        some = np.flatnonzero(links)
        out_node += [node[rows[i]] for i in some]
        out_links += links[some].tolist()
        out_root += [node[rows[label[i]]] for i in some]
    if not out_node:
        return None
    return pa.table({"node": pa.array(out_node, pa.binary()), "links": pa.array(out_links, pa.int64()),
                     "root": pa.array(out_root, pa.binary())})


def _sized(keys: DataFrame, name: str) -> DataFrame:
    """Rows whose prefix is shared, with the number of its nodes; a prefix may hold a large share."""
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    hot = shared.filter(F.col("size") > GROUP_ROWS).withColumnRenamed("size", "rows")
    return written(salted_join(keys, shared, ["key"], salts=salts_of(hot, ["key"])), name)


def forest(nodes: DataFrame, rows: DataFrame, k: int, threshold: float, trees: int, target: float,
           bucket_rows: int) -> DataFrame:
    """(node, key, size): the prefixes at which nodes stand together, with their number.

    A round extends the prefixes that were crowded, but only of nodes that lack recall without them.
    `lacking` is the logarithm of the chance of a miss that a node may still spend, `joined` its trees.
    """
    first = prefix_depth(trees, threshold, target)
    depths = [first * step for step in STEPS]
    budget = math.log(1 - target)
    keys = nodes.select("node", F.posexplode("keys").alias("tree", "key"))
    state = nodes.select("node", "first", F.lit(trees).alias("joined"), F.lit(budget).alias("lacking"),
                         F.array().cast("array<int>").alias("settled"))
    buckets = None
    for round_, depth in enumerate(depths):
        met = _sized(keys, "met")
        last = round_ == len(depths) - 1
        kept = met if last else met.filter(F.col("size") <= bucket_rows)
        kept = kept.select("node", "key", "size")
        buckets = kept if buckets is None else buckets.unionByName(kept)
        crowded = met.filter(F.col("size") > bucket_rows)
        if last or crowded.isEmpty():
            break
        full = crowded.groupBy("node").agg(F.collect_set("tree").alias("full"))  # at most all trees
        every = F.sequence(F.lit(0), F.col("joined") - 1)
        uncrowded = F.array_except(every, F.array_union("full", "settled"))
        longer = depths[round_ + 1]
        more = F.ceil(F.col("lacking") / log_miss(longer, threshold)).cast("int") - F.size("full")
        state = (state.join(full, "node")
                 .withColumn("lacking", F.col("lacking") - F.size(uncrowded) * log_miss(depth, threshold))
                 .filter("lacking < 0")
                 .withColumn("settled", F.array_union("settled", uncrowded))
                 .withColumn("joined", F.col("joined") + F.greatest(more, F.lit(0))))
        state = written(state.drop("full"), "lacking")
        texts = rows.join(state.select(F.col("first.ka").alias("ka"), F.col("first.kb").alias("kb"),
                                       "node", "joined", "settled"), ["ka", "kb"])
        width = max(trees, trees_for(longer, threshold, target))
        paths = texts.select("node", "joined", "settled", path_column(k, width, longer)("text").alias("keys"))
        once = paths.groupBy("node").agg(F.first(F.struct("joined", "settled", "keys")).alias("p"))  # a row may repeat
        keys = written(once.select("node", "p.settled", F.posexplode(F.slice("p.keys", F.lit(1), F.col("p.joined")))
                                   .alias("tree", "key"))
                       .filter(~F.array_contains("settled", F.col("tree"))).drop("settled"), "paths")
    return buckets


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS,
                    threshold: float = THRESHOLD, trees: int = TREES, target: float = RECALL,
                    bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: its row key (ka, kb), doc_id, class_id, n_links, and the row key of
    the class's first document (first.id, first.ka, first.kb)."""
    depth = prefix_depth(trees, threshold, target)
    enough = sketch_matches(trees * depth, threshold)
    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(rows.select("ka", "kb", "doc_id", signature_column(k, trees, depth)("text").alias("s"))
                     .select("ka", "kb", "doc_id", "s.*"), "signed")
    worded = signed.filter("n > 0")
    nodes = written(worded.groupBy("node", "n", "keys", "sketch").agg(
        F.count(F.lit(1)).alias("w"), F.min(F.struct("doc_id", "ka", "kb")).alias("first")), "nodes")

    buckets = forest(nodes, rows, k, threshold, trees, target, bucket_rows)
    met = tiles(buckets.join(nodes.select("node", "sketch"), "node"),
                F.ceil(F.col("size") / bucket_rows), "node")
    edges = by_group(met.select("key", "x", "y", "own", "node", "sketch"), ["key", "x", "y"],
                     lambda t, b: _matching(t, b, enough), "a binary, b binary")
    groups = written(components(edges), "groups")

    members = groups.join(nodes.select("node", "n", "w", "first"), "node")
    sizes = members.groupBy("root").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / block_rows, F.sum("n") / BLOCK_SHINGLES)).alias("size"))
    texts = rows.join(members.select(F.col("first.ka").alias("ka"), F.col("first.kb").alias("kb"),
                                     "node", "w", F.col("root").alias("grp")), ["ka", "kb"])
    sets = texts.select("grp", "node", "w", set_column(k)("text").alias("shingles"))
    sets = sets.join(sizes.select(F.col("root").alias("grp"), "size"), "grp")
    tiled = tiles(sets, F.col("size"), "node").select("grp", "x", "y", "own", "node", "w", "shingles")
    found = written(by_group(tiled, ["grp", "x", "y"], lambda t, b: _verified(t, b, threshold),
                             "node binary, links long, root binary"), "verified")

    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classed = (nodes.select("node", "w", "first").join(roots, "node", "left").join(links, "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    heads = classed.groupBy("root").agg(F.min("first").alias("head"))
    classed = written(classed.join(heads, "root").select(
        "node", "head", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    own = F.struct("doc_id", "ka", "kb")
    named = signed.select("ka", "kb", "doc_id", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    alone = named.filter("node is null").select(
        "ka", "kb", "doc_id", own.alias("head"), F.lit(0).cast("long").alias("n_links"))
    joined = named.filter("node is not null").join(classed, "node").select(
        "ka", "kb", "doc_id", "head", "n_links")
    return joined.unionByName(alone).select(
        "ka", "kb", "doc_id", F.col("head.doc_id").alias("class_id"), "n_links", F.col("head").alias("first"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each class kept: that with the smallest id, and of rows that repeat
    it one. Wordless documents stay."""
    from pyspark.sql import Window

    found = near_duplicates(docs, id_col, text_col, **options)
    first = (F.col("ka") == F.col("first.ka")) & (F.col("kb") == F.col("first.kb"))
    kept = found.filter(first).select("ka", "kb").distinct()
    packed = docs.select(F.struct(*docs.columns).alias("doc"), *row_key(id_col, text_col),
                         F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    nth = F.row_number().over(Window.partitionBy("ka", "kb").orderBy("worded"))
    return (packed.join(kept, ["ka", "kb"]).withColumn("nth", nth)
            .filter("nth = 1 or not worded").select("doc.*"))
