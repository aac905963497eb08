"""The registered queries of the training-data operators. Each covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import decontaminate as bench
from wayfare.llm import conversations, exact_copies, language, ngram_join, packing, quality, repeats, runs
from wayfare.llm import sharding, token_files, urls, warc
from wayfare.llm.common import table, written
from wayfare.llm.tokens import vocabulary
from wayfare.session import scratch_path

END_OF_FILE_ID, END_OF_DOCUMENT_ID = 0, 1

# fixed rules of the URL query
URL_RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from the labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.filter(~language.held_out() & F.col("lang").isNotNull())
    found = language.identify(docs.select("doc_id", "text"), language.parsers(labelled))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum as read back from the token files."""
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(
        docs, scratch_path(spark, "tokens"), vocabulary(), end_id=END_OF_FILE_ID)
    return token_files.read_token_files(manifest)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives."""
    index, folder = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.read_records(index, folder)
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near-equal bytes."""
    found = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or model verdict on every URL."""
    found = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without repeated strings of 200 bytes."""
    found = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", (F.octet_length("found.kept") + F.col("found.removed")).alias("n_bytes"),
                        F.col("found.removed").alias("n_removed"), "found.n_spans",
                        F.sha2("found.kept", 256).alias("kept_sha256"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-equal texts of every document and the number of its links."""
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    found = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "n_lines")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence."""
    found = packing.pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=END_OF_DOCUMENT_ID)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark occurs in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bench.found_windows(docs, table(spark, sf_dir, "benchmark"))
    n_hit = bench.hit_words()
    return found.select(
        "doc_id", "found.n_words", n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("found.items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The texts in which the contract of op11 makes words periodic, by doc_id; others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parted = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all(
        "text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"), F.floor(h / 10).alias("g"))
    n, start = F.size("words"), (F.col("g") % F.size("words")).cast("int")
    placed = parted.withColumns({"n": n, "a": F.when(n > 0, start)})
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    rest = F.col("n") - F.col("a")
    block = F.slice("words", F.col("a") + 1, F.col("period"))
    copies = F.flatten(F.array_repeat(block, F.ceil(rest / F.col("period")).cast("int")))
    repeated = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), rest))
    return placed.withColumn("period", period).select("doc_id", F.when(
        F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every text and what is left without them."""
    docs = _made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.with_runs(docs).withColumn("best", runs.longest(F.col("found.runs")))
    lines = F.transform("found.runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("found.runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("found.collapsed", 256).alias("collapsed_sha256"))


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of equal texts stays, for every document."""
    found = exact_copies.exact_copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                        F.lower(F.hex("digest")).alias("text_sha256"))


def _rebuilt(lists: DataFrame) -> DataFrame:
    """Turn lists as the contract of op13 rebuilds them: first turns of another, then the own rest."""
    base = lists.select(F.col("conv_id").alias("base"), F.slice("steps", 1, 8).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    own = lists.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": h})
    none = F.array().cast(lists.schema["steps"].dataType)
    first = F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))
    rest = F.slice("steps", F.col("h") + 1, F.size("steps"))
    return own.join(base, "base", "left").select("conv_id", F.concat(first, rest).alias("steps"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    lists = written(conversations.turn_lists(table(spark, sf_dir, "conversations")), "turns")
    paths = written(conversations.sequences(_rebuilt(lists)), "paths")
    found = conversations.prefix_trie(paths).join(conversations.end_digests(paths), "id", "left")
    return found.select(
        "conv_id", F.col("depth").cast("long"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op")}
ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH payloads AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        sized AS (SELECT page_id, octet_length(payload) AS bytes, sha256(payload) AS digest FROM payloads),
        firsts AS (SELECT digest, min(page_id) AS own FROM sized WHERE bytes >= 100 GROUP BY digest),
        owned AS (SELECT s.*, coalesce(f.own, s.page_id) AS own
            FROM sized s LEFT JOIN firsts f ON f.digest = s.digest)
        SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
            CASE WHEN own IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN own IS DISTINCT FROM page_id THEN own END AS refers_to
        FROM owned""",
    "op10_decontamination": r"""
        WITH spelled AS (SELECT item_id, regexp_extract_all(translate(text,
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        placed AS (SELECT *, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
            FROM spelled WHERE len(w) > 0),
        wanted AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words FROM placed),
        texts AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text,
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        starts AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
            FROM texts JOIN (SELECT DISTINCT k FROM wanted) ON k <= len(w)),
        hits AS (SELECT r, i, k, item_id FROM (
            SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS words FROM starts) JOIN wanted USING (k, words)),
        covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (
            SELECT r, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY 1),
        named AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (
            SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            coalesce(digest, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM texts LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op12_exact_copies": r"""
        WITH normal AS (SELECT doc_id,
            regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            row_number() OVER (same ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
        FROM normal WINDOW same AS (PARTITION BY text)""",
    "op13_conversation_trie": """
        WITH turns AS (SELECT conv_id, turn, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '')
                || coalesce(text, '')) AS mark, octet_length(encode(coalesce(text, ''))) AS bytes
            FROM conversations WHERE conv_id IS NOT NULL),
        numbered AS (SELECT *, row_number() OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS pos FROM turns),
        hashed AS (SELECT conv_id, n, xor(list_reduce(flatten([[4294967295], flatten(list_transform(
                string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))]),
                lambda c, e: CASE WHEN e >= 0 THEN xor(c, e)
                    ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 9 AS h
            FROM (SELECT conv_id, count(*) AS n FROM numbered GROUP BY 1)),
        based AS (SELECT c.conv_id, c.h, c.conv_id - c.conv_id % 5 AS base, least(c.h, coalesce(b.n, 0)) AS taken
            FROM hashed c LEFT JOIN hashed b ON b.conv_id = c.conv_id - c.conv_id % 5),
        rebuilt AS (SELECT c.conv_id, t.pos AS depth, t.mark, t.bytes
            FROM based c JOIN numbered t ON t.conv_id = c.base AND t.pos <= c.h
            UNION ALL SELECT c.conv_id, t.pos - c.h + c.taken, t.mark, t.bytes
            FROM based c JOIN numbered t ON t.conv_id = c.conv_id AND t.pos > c.h),
        paths AS (SELECT conv_id, depth, bytes, string_agg(mark, '') OVER (
            PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
            UNION ALL SELECT conv_id, 0, 0, '' FROM based),
        ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM (
            SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY 1) GROUP BY 1),
        nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes
            FROM paths GROUP BY 1, 2),
        counted AS (SELECT n.*, p.conv_id AS parent_conv_id, (
                SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[:32 * n.depth] = n.path) AS n_children
            FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:32 * (n.depth - 1)]),
        upward AS (SELECT path[:32 * up] AS path, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT)
                AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
            FROM (SELECT *, unnest(range(depth + 1)) AS up FROM counted) GROUP BY 1)
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
            coalesce(digest, sha256('')) AS ends_sha256
        FROM counted JOIN upward USING (path) LEFT JOIN ends USING (path)""",
}
