"""Importance resampling towards a target distribution over hashed n-grams, on whole texts.

Identical texts are collapsed by grouping the full text; each distinct text's features are taken once and counted as often
as it stands; the logarithms of target over source mass give every bucket a gain, the mean gain of a text's features its
weight. The weights are joined back to the documents, and only then each document gets noise of its own (Gumbel, from a
hash of its id), so the highest scores are a draw without replacement in proportion to exp(weight / 1000).

A null text is an empty one, and an empty one has no features and weight 0. A null id is the empty id in the hash, and
comes first among ties. Rows that share id and text are rows of their own with one score; their order among each other is
free. A text of any length is taken whole. An empty table gives an empty result; an empty target makes all gains those of
unseen features. Columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.operators.ranking import global_rank

from .common import staged

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Documents of fewer words aren't drawn; of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(1))


def features(w: str, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """Of a column of words the bucket of every run of 1 to `longest` of them, repeats included. It must be a column: an expression would be taken anew for each run."""
    n, runs = F.size(w), [F.col(w)]

    def run(k: int) -> Callable[[Column], Column]:
        return lambda i: F.concat_ws(" ", *[F.get(w, i + (j - 1)) for j in range(k)])

    for k in range(2, longest + 1):
        starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, run(k)))
    every = runs[0] if longest == 1 else F.concat(*runs)
    return F.transform(every, lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int"))


def collapsed(docs: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(key, copies, words, b) of each distinct text: the digest of its bytes, its rows, its words, its features' buckets."""
    each = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    told = each.select(_key(F.col("text")), "copies", words(F.col("text")).alias("w"))
    return told.select("key", "copies", F.size("w").cast("long").alias("words"), features("w", longest, buckets).cast("array<smallint>" if buckets <= 1 << 15 else "array<int>").alias("b"))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256)).alias("key")


def masses(texts: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket, those of repeated texts counted as often as they stand."""
    found = texts.select("copies", F.explode("b").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias("n"))
    out = [0] * buckets
    for r in found.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int], spark) -> list[int]:
    """floor(1000 ln(target share / source share)) of each bucket, one feature added to each."""
    n, all_s, all_t = len(source), float(sum(source)), float(sum(target))
    rows = spark.createDataFrame([(k, float(s), float(t)) for k, (s, t) in enumerate(zip(source, target, strict=True))], "k int, s double, t double")
    ratio = (F.col("t") + 1.0) * (all_s + n) / ((F.col("s") + 1.0) * (all_t + n))
    out = [0] * n
    for r in rows.select("k", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("g")).collect():  # one row a bucket
        out[r["k"]] = r["g"]
    return out


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, of the document alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Of every document: id, n_features, weight, score, rank (null where it isn't drawn), all long."""
    spark = docs.sparkSession
    texts = staged(collapsed(docs, text_col, longest, buckets), "distinct-texts")
    gain = gains(masses(texts, buckets), masses(collapsed(target, target_col, longest, buckets), buckets), spark)
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one constant
    total, n = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.get(table, x.cast("int"))), F.size("b").cast("long")
    # The sum less its remainder is divided, so the quotient is exact and goes down.
    known = texts.select("key", "words", n.alias("n_features"), total.alias("_sum")).withColumn("weight", F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(_sum - pmod(_sum, n_features)) div n_features"))).drop("_sum")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(F.coalesce(F.col(text_col), F.lit(""))))
    scored = staged(ids.join(known, "key").select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("words") >= least_words).alias("can")), "weights")
    draws = scored.where("can").count() * percent // 100
    # Only what can be drawn is ordered, by ranges; ties are few, the ids break them.
    ranked = global_rank(scored.where("can"), [], [F.desc("score"), F.col("doc_id")], "rank").withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")).cast("long"))
    rest = scored.where(~F.col("can")).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def _crc_table() -> list[int]:
    """The table of the reflected polynomial 0xEDB88320, from its rule."""
    out = []
    for k in range(256):
        for _ in range(8):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return out


def sql() -> str:
    """The production query in DuckDB's SQL. Words are hashed byte by byte, each distinct one once."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {words} AS ws FROM documents),
dw AS (SELECT row_id, unnest(ws) AS w FROM d), tw AS (SELECT unnest({words}) AS w FROM benchmark),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
bytes AS (SELECT w, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT) AS bs FROM hexed),
bucket AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[((xor(c, b)) & 255) + 1]))) % {BUCKETS} AS b FROM bytes),
s AS (SELECT b, count(*) AS n FROM dw JOIN bucket USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM tw JOIN bucket USING (w) GROUP BY b),
g AS (SELECT s.b, floor(1000.0::DOUBLE * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {BUCKETS})::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
sums AS (SELECT row_id, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN bucket USING (w) JOIN g USING (b) GROUP BY row_id),
x AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE ((total - ((total % n) + n) % n) // n)::BIGINT END AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN sums USING (row_id)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= (SELECT count(*) FROM y WHERE n_features >= {LEAST_WORDS}) * {PERCENT} // 100 THEN place END AS rank FROM r"""
