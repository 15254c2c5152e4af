"""Queries of the stored positional index, built from `documents` with the source as title."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import index as I
from ..functions import retrieval as R
from ..storage import shared_dir
from ..storage import table as T
from .retrieval import _Q_SQL, _asked


def _built(spark, d):
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    I.add(T(spark, d, "documents").select("doc_id", "source", "text"), root, "doc_id", "source", "text")
    return root


def _searched(spark, d, root):
    asked = _asked(spark, d, 10).select("item_id", R.query_terms(F.col("text")).alias("terms"))
    return I.search(spark, root, asked, "item_id", "terms", 10)


def index_search(spark, d):
    """every tenth benchmark text as a question, answered from the index."""
    found, _ = _searched(spark, d, _built(spark, d))
    return found.select("item_id", F.col("doc").alias("doc_id"), "rank", F.round("bm25", 6).alias("bm25"))


def index_cost(spark, d):
    """of each question the slabs and blocks that hold its words, and those that were read."""
    return _searched(spark, d, _built(spark, d))[1]


def index_update(spark, d):
    """One title is removed and one replaced by shorter texts; the same questions, answered from the changed index."""
    root, docs = _built(spark, d), T(spark, d, "documents")
    I.remove(spark, root, ["src1"])
    I.add(docs.where("source = 'src2'").select("doc_id", "source", F.substring("text", 1, 300).alias("text")), root, "doc_id", "source", "text", replace=True)
    found, _ = _searched(spark, d, root)
    return found.select("item_id", F.col("doc").alias("doc_id"), "rank", F.round("bm25", 6).alias("bm25"))


def index_phrases(spark, d):
    """phrases by positions."""
    asked = spark.createDataFrame([("gpl", ["general", "public", "license"]), ("of", ["the", "the"]), ("apache", ["apache", "license"])], "name string, words array<string>")
    return I.phrases(spark, _built(spark, d), asked, "name", "words").select("name", F.col("doc").alias("doc_id"), F.col("n_hits").cast("int").alias("n_hits"))


def index_prefixes(spark, d):
    return I.prefixes(spark, _built(spark, d), "licens").select(F.col("doc").alias("doc_id"), F.col("n_hits").cast("int").alias("n_hits"))


_TOP = "SELECT item_id, doc_id, rank, round(b, 6) AS bm25 FROM (SELECT item_id, doc_id, b, row_number() OVER (PARTITION BY item_id ORDER BY b DESC, doc_id) rank FROM bm) WHERE rank <= 10"
_TEN = _Q_SQL.replace("item_id % 100 = 0", "item_id % 10 = 0")
_CHANGED = _TEN.replace("FROM documents)", "FROM (SELECT doc_id, source, CASE WHEN source = 'src2' THEN substr(text, 1, 300) ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src1'))")
#: Words of a text between two blanks, so that a phrase is found wherever it begins.
_PHRASE = r"SELECT '{name}' AS name, doc_id, n AS n_hits FROM (SELECT doc_id, len(list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + {last}] = {words}))::INT AS n FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+') AS ws FROM documents)) WHERE n > 0"
QUERIES = {
    "index_search": (index_search, f"WITH {_TEN} {_TOP}"),
    "index_cost": (index_cost, None),
    "index_update": (index_update, f"WITH {_CHANGED} {_TOP}"),
    "index_phrases": (index_phrases, " UNION ALL ".join(_PHRASE.format(name=n, last=len(w) - 1, words=w) for n, w in (("gpl", ["general", "public", "license"]), ("of", ["the", "the"]), ("apache", ["apache", "license"])))),
    "index_prefixes": (index_prefixes, r"SELECT doc_id, n_hits FROM (SELECT doc_id, len(list_filter(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+'), lambda x: starts_with(x, 'licens')))::INT AS n_hits FROM documents) WHERE n_hits > 0"),
}
