"""Exact dedup by deterministic block naming, in DataFrame operations only.

Each text, without blanks, is cut into blocks of a fixed number of characters. Blocks are grouped by their whole content,
and each distinct content gets an integer name (the least running number of its occurrences), so equal names mean equal
blocks: no fingerprint decides. Adjacent names are paired and the pairs named in the same way, level by level, until one
name is left for each document; with the number of blocks it identifies the text without collision.

Only names travel back to the documents. They are looked up by a 64-bit digest of the block, which is first verified
against the grouped contents to tell all of them apart; if two contents shared a digest, another seed would be taken.

Nulls: a null text counts as empty, empty texts equal each other; a null id ranks after all others. Ties in length go to
the smallest id, then to the row read first, so of repeated rows one stays. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_each, staged, with_rows

#: Characters in a block.
BLOCK = 8192


def normalised(text: Column) -> Column:
    """The text without the characters [ \\t-\\r]; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+", "")


def _named(occurrences: DataFrame, content: list[str], name: str) -> DataFrame:
    """digest -> name for the distinct contents, staged; the digest is collision-free on them. Adds column _seed."""
    for seed in range(8):
        digest = F.xxhash64(F.lit(seed), *content)
        names = staged(occurrences.groupBy(*content).agg(F.min("_number").alias("_name")).select(digest.alias("_digest"), "_name"), name)
        clash = names.groupBy("_digest").count().where("count > 1").limit(1).count()
        if not clash:
            return names.withColumn("_seed", F.lit(seed))
    raise RuntimeError("no seed tells all blocks apart")


def _looked_up(occurrences: DataFrame, names: DataFrame, content: list[str]) -> DataFrame:
    """The occurrences with the name of their content in the content's place."""
    seed = names.select("_seed").first()
    digest = F.xxhash64(F.lit(seed[0] if seed else 0), *content)
    return occurrences.withColumn("_digest", digest).drop(*content, "_number").join(names.drop("_seed"), "_digest").drop("_digest")


def _gathered(named: DataFrame, carried: list[str]) -> DataFrame:
    """One row per document again, its names in order."""
    rows = named.groupBy("_row").agg(*[F.first(c).alias(c) for c in carried], F.array_sort(F.collect_list(F.struct("_at", "_name"))).alias("_n"))
    return rows.withColumn("_names", F.col("_n._name")).drop("_n")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """_row, id, _chars (code points of the original text), text_sha256 (of the normalised text), _blocks and _name: equal (_blocks, _name) means equal normalised texts."""
    norm = normalised(F.col(text_col))
    cut = F.when(F.length("_norm") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("_norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_chars"), norm.alias("_norm"))
    rows = rows.select("_row", "_id", "_chars", F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"), cut.alias("_cut"))
    blocks = rows.select("_row", "_id", "_chars", "_sha", F.size("_cut").alias("_blocks"), F.posexplode("_cut").alias("_at", "_block")).withColumn("_number", F.monotonically_increasing_id())
    names = _named(blocks.select("_block", "_number"), ["_block"], "block-names")
    carried = ["_id", "_chars", "_sha", "_blocks"]
    current = staged(_gathered(_looked_up(blocks, names, ["_block"]), carried), "named-0")
    level = 0
    while (current.agg(F.max(F.size("_names"))).first()[0] or 0) > 1:
        level += 1
        pair = lambda i: F.struct(F.get("_names", 2 * i).alias("_l"), F.coalesce(F.get("_names", 2 * i + 1), F.lit(-1)).alias("_r"))
        open_ = current.where(F.size("_names") > 1)
        half = F.transform(F.sequence(F.lit(0), F.floor((F.size("_names") - 1) / 2).cast("int")), pair)
        pairs = open_.select("_row", *carried, F.posexplode(half).alias("_at", "_p")).select("_row", *carried, "_at", "_p._l", "_p._r").withColumn("_number", F.monotonically_increasing_id())
        names = _named(pairs.select("_l", "_r", "_number"), ["_l", "_r"], "pair-names")
        done = current.where(F.size("_names") <= 1)
        current = staged(_gathered(_looked_up(pairs, names, ["_l", "_r"]), carried).unionByName(done), f"named-{level}")
    return current.select("_row", F.col("_id").alias(id_col), "_chars", F.col("_sha").alias("text_sha256"), "_blocks", F.get("_names", 0).alias("_name"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    known = identities(docs, id_col, text_col, block)
    # ~id falls as the id rises, and can't overflow; nulls come lowest.
    rank = F.struct("_chars", F.bitwise_not(F.col(id_col)), F.bitwise_not("_row"))
    groups = staged(known.groupBy("_blocks", "_name").agg(F.max_by(F.struct(F.col("_row"), F.col(id_col).alias("_id")), rank).alias("_best"), F.count(F.lit(1)).alias("group_size")), "copy-groups")
    return known.join(groups, ["_blocks", "_name"]).select(id_col, F.col("_best._id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256")


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names. Of equal rows one stays, as in `dedup`."""
    decided = dedup(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("key"), "kept")
    return one_each(docs, with_rows(decided), id_col, F.sha2(normalised(F.col("doc").getField(text_col)).cast("binary"), 256), text_col)


#: The same rows in SQL.
SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]', '', 'g') AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) = 1 AS kept, sha256(s) AS text_sha256
FROM n
"""
