"""Queries of plans, costs and cards, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planning as P
from ..functions import text as X
from ..storage import table as T


def page_costs(spark, d):
    p = X.lines_of(T(spark, d, "documents").where("text is not null"), "doc_id", "text")
    n = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    p = p.join(n, "doc_id").withColumn("pdf", F.col("doc_id") % 2 == 0)
    return p.groupBy("doc_id", P.page_block(F.col("line_no"), F.col("n"), F.col("pdf"), 10, 4).alias("block")).agg(F.sum(P.page_tokens(F.col("line"), F.col("pdf"))).alias("cost"))


def token_estimates(spark, d):
    return T(spark, d, "documents").select("doc_id", P.estimated_tokens(F.col("n_chars"), F.col("doc_id") % 7).alias("tokens"))


def checked_cards(spark, d):
    b = T(spark, d, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 2 == 0, F.substring("text", 1, 30)).otherwise("not in the text at all").alias("title"), F.array(F.lit("The, X."), F.lit("Nobody, Y.")).alias("authors"), F.lit(1987).alias("year"), F.lit("https://doi.org/10.1000/ABC.").alias("doi"))
    b = b.withColumn("text", F.concat("text", F.when(F.col("item_id") % 3 == 0, " doi:10.1000/abc").otherwise("")))
    c = P.checked_card(b, "text")
    return c.select("item_id", F.col("title").isNotNull().alias("has_title"), F.size("authors").alias("n_authors"), F.col("year").isNotNull().alias("has_year"), F.col("doi").isNotNull().alias("has_doi"))


def time_grids(spark, d):
    return T(spark, d, "region").select("r_regionkey", F.explode(P.time_grid(10.0, 5)).alias("t"))


def filled_pieces(spark, d):
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(P.filled("text", F.lit(110))).alias("k", "p")).select("doc_id", "k", F.length("p").alias("n_chars"))


QUERIES = {
    "page_costs": (page_costs, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) p, len(string_split(text, chr(10))) n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND n > 10 THEN (p - 1) // 4 ELSE 0 END AS block, sum(CASE WHEN doc_id % 2 = 0 THEN 575 + ceil(least(length(line), 120) / 3) ELSE 15 + ceil(length(line) / 3) END)::BIGINT AS cost FROM l GROUP BY 1, 2"),
    "token_estimates": (token_estimates, "SELECT doc_id, n_chars // 3 + doc_id % 7 AS tokens FROM documents"),
    "checked_cards": (checked_cards, r"SELECT item_id, item_id % 2 = 0 AS has_title, list_contains(regexp_extract_all(strip_accents(lower(text)), '\p{L}+'), 'the')::INT + list_contains(regexp_extract_all(lower(text), '\p{L}+'), 'nobody')::INT AS n_authors, contains(text, '1987') AS has_year, item_id % 3 = 0 AS has_doi FROM benchmark"),
    "time_grids": (time_grids, "SELECT r_regionkey, unnest([0.0::DOUBLE, 1, 2.5, 5, 7.5, 10]) AS t FROM region"),
    "filled_pieces": (filled_pieces, None),
}
