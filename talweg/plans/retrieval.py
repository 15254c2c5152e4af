"""Queries of retrieval, ranking and budgets over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fusion as U
from ..functions import retrieval as R
from ..operators import library as L
from ..operators import ranking as K
from ..storage import table as T

_STOP = "(" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + ")"
_WORDS = r"regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')"
#: Questions: benchmark items whose number is divisible by 100 (plans of several units: by 10), their distinct words that aren't stop words.
_Q_SQL = rf"""
bm0 AS (SELECT * FROM benchmark WHERE item_id % 100 = 0),
q AS (SELECT item_id, w AS term FROM (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY p) r FROM (
    SELECT item_id, w, min(p) p FROM (SELECT item_id, unnest(ws) w, generate_subscripts(ws, 1) p FROM (SELECT item_id, {_WORDS} ws FROM bm0)) GROUP BY 1, 2)
  WHERE w NOT IN {_STOP}) WHERE r <= 40),
toks AS (SELECT doc_id, source, {_WORDS} ws FROM documents),
stat AS (SELECT count(*) n, avg(len(ws)) avgl FROM toks),
tf AS (SELECT doc_id, l, term, count(*) tf FROM (SELECT doc_id, len(ws) l, unnest(ws) term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) df FROM tf GROUP BY 1),
bm AS (SELECT item_id, doc_id, round(sum(greatest_idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgl))), 9) AS b FROM (
    SELECT q.item_id, tf.doc_id, tf.tf, tf.l, stat.avgl, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS greatest_idf
    FROM tf JOIN df USING (term) JOIN q USING (term), stat) GROUP BY 1, 2)"""


def _asked(spark, d, every=100):
    """The stated query set."""
    return T(spark, d, "benchmark").where(F.col("item_id") % every == 0)


def _lexical(spark, d, every=100):
    questions = _asked(spark, d, every).select("item_id", R.query_terms(F.col("text")).alias("terms"))
    scored = R.bm25(T(spark, d, "documents"), questions, "doc_id", "text", "item_id", "terms")
    return scored.withColumn("bm25", F.round("bm25", 9))


def bm25_topk(spark, d):
    # The rank limits the rows before the shuffle, so no group is gathered whole.
    top = K.sequence_rank(_lexical(spark, d), [F.desc("bm25"), F.col("doc_id")], "rank", ["item_id"]).where("rank <= 10")
    return top.select("item_id", "doc_id", "rank", F.round("bm25", 6).alias("bm25"))


def _keyed(docs):
    """Documents under one key that carries their source along."""
    return docs.withColumn("chunk", F.struct(F.col("doc_id").alias("key"), F.col("source").alias("group")))


def _similar(spark, d, every=100):
    """Similarity of every document's vector (that of its number) to every question's: the question's own vector is the one of its number."""
    v = T(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = _asked(spark, d, every).select("item_id").join(T(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id")).select("item_id", F.col("embedding").alias("q"))
    held = _keyed(v.join(T(spark, d, "documents").select("doc_id", "source"), "doc_id"))
    scored = R.cosine_scores(held, q, "chunk", "embedding", "item_id", "q", with_own=True)
    return scored.select(F.col("item_id").alias("query"), "chunk.key", "chunk.group", F.round("similarity", 9).alias("by"))


def _worded(spark, d, every=100):
    questions = _asked(spark, d, every).select("item_id", R.query_terms(F.col("text")).alias("terms"))
    scored = R.bm25(_keyed(T(spark, d, "documents").select("doc_id", "source", "text")), questions, "chunk", "text", "item_id", "terms")
    return scored.select(F.col("item_id").alias("query"), "chunk.key", "chunk.group", F.round("bm25", 9).alias("by"))


def _named(spark, d, every=100):
    """The collections that a question names: here it is asked of "collected notes" of the source of its number, among others with their accents."""
    cards = T(spark, d, "documents").select("source").distinct().select("source", F.concat(F.lit("Collected nótes, "), "source").alias("title"))
    asked = _asked(spark, d, every).select("item_id", F.concat("text", F.lit(" (colléctèd notes src"), (F.col("item_id") % 30).cast("string"), F.lit(")")).alias("question"))
    return L.titles_in(asked, "item_id", "question", cards, "title").select(F.col("item_id").alias("query"), F.col("source").alias("group"))


def _fused(spark, d, need, every=100, cap=None):
    """The first candidates of every question: item_id, doc_id, source, score, similarity."""
    found = U.best(_similar(spark, d, every), _worded(spark, d, every), _named(spark, d, every), need, cap)
    return found.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), F.col("group").alias("source"), "score", "similarity")


def _ranked(spark, d, most, every=100):
    """The first `most` candidates of each question; only they are ordered in one place."""
    return K.sequence_rank(_fused(spark, d, most, every), [F.desc("score"), F.col("doc_id")], "fused_rank", ["item_id"]).where(F.col("fused_rank") <= most)


def hybrid_search(spark, d):
    """meaning, words and named documents fused, at most two of a source, each hit with its first description."""
    capped = K.capped(_fused(spark, d, 6, cap=2), "source", [F.desc("score"), F.col("doc_id")], 2, 6, ["item_id"])
    notes = T(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.substring("text", 1, 40).alias("note"))
    hits = L.caption_descriptions(capped, notes, ["doc_id"], "turn", "note")
    return hits.select("item_id", "doc_id", "source", "place", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"), "description")


_HYBRID_SQL = f"""WITH {_Q_SQL},
sem AS (SELECT b.vec_id item_id, a.vec_id doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) s
    FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT item_id FROM bm0) AND a.vec_id IN (SELECT doc_id FROM documents)),
named AS (SELECT item_id, doc_id FROM bm0 JOIN documents ON contains(regexp_replace(strip_accents(lower(bm0.text || ' (colléctèd notes src' || (item_id % 30) || ')')), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 'collectednotes' || source)),
lists AS (SELECT item_id, doc_id, 1.0 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id)) p, s, 0 l FROM sem
    UNION ALL SELECT item_id, doc_id, 0.5 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY b DESC, doc_id)), NULL, 1 FROM bm
    UNION ALL SELECT item_id, doc_id, 1.0 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id)), NULL, 2 FROM sem SEMI JOIN named USING (item_id, doc_id)),
fused AS (SELECT item_id, doc_id, source, round(sum(p), 9) score, max(s) similarity FROM lists JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1, 2, 3 HAVING max(l) > 0 OR max(s) >= 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) fused_rank FROM fused)"""
_PLANS_SQL = _HYBRID_SQL.replace("item_id % 100 = 0", "item_id % 10 = 0")
_DIVERSE_SQL = """e AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY fused_rank) <= 2 AS ok FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ok DESC, fused_rank) pick FROM e)"""


def rrf_fusion(spark, d):
    return _ranked(spark, d, 20).select("item_id", "doc_id", "fused_rank", F.round("score", 6).alias("score"))


def source_diversity(spark, d):
    return K.spread_sources(_ranked(spark, d, 30), "source", "fused_rank", 4, ["item_id"]).select("item_id", "doc_id", "source", "place")


def page_rerank(spark, d):
    """W13 over a rank-then-rerank cascade: the second score (here the length in characters) is only taken for the pool."""
    pool = _ranked(spark, d, 60).join(T(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("second")), "doc_id")
    return K.group_best(pool, "source", "fused_rank", "second", 60, 2, ["item_id"])


def ranked_pages(spark, d):
    """Of each question and source the first distinct pages (here blocks of ten documents) among the pool of 60."""
    pool = _ranked(spark, d, 60).withColumn("page", F.floor(F.col("doc_id") / 10))
    return K.ranked_places(pool, ["item_id", "source"], "page", "fused_rank", 20).select("item_id", "source", "page", "place")


def interleave(spark, d):
    lists = _ranked(spark, d, 10, 10).select(F.floor(F.col("item_id") / 40).alias("plan"), F.col("item_id").alias("unit"), "fused_rank", "doc_id")
    return K.interleave(lists, "unit", "fused_rank", "doc_id", 12, ["plan"])


def unit_search(spark, d):
    """Each unit (question) of a plan searched, its sources spread, the units' lists interleaved; then each unit's pages reranked."""
    hits = _ranked(spark, d, 20, 10).withColumn("plan", F.floor(F.col("item_id") / 40))
    second = T(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("second"))
    return K.search_units(hits.join(second, "doc_id"), "plan", "item_id", "doc_id", "source", "fused_rank", "second", 3, 10)


def term_mentions(spark, d):
    return R.term_mentions(T(spark, d, "documents"), ["license", "the", "idiot", "version"], "doc_id", "text", "source")


def phrase_match(spark, d):
    return R.phrase_hits(T(spark, d, "documents"), "doc_id", "text", ["general", "public", "license"])


def prefix_match(spark, d):
    return R.prefix_hits(T(spark, d, "documents"), "doc_id", "text", "licens")


def _vector_queries(spark, d):
    """The stated query set: vectors whose number is divisible by 100."""
    return T(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def cosine_topk(spark, d):
    return R.cosine_top(T(spark, d, "embeddings"), _vector_queries(spark, d), "vec_id", "embedding", "query_id", "q", 5).withColumn("similarity", F.round("similarity", 6))


def _evaluated(spark, d):
    v = T(spark, d, "embeddings")
    hits = R.cosine_top(v, _vector_queries(spark, d), "vec_id", "embedding", "query_id", "q", 6)
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    return hits.join(v.select("vec_id", "label"), "vec_id").join(asked, "query_id")


def retrieval_eval(spark, d):
    h = _evaluated(spark, d).withColumn("relevant", F.col("label") == F.col("asked")).withColumn("even", (F.col("query_id") % 200 == 0).cast("int"))
    return R.retrieval_summary(h, "query_id", "relevant", "rank", "label", ["asked", "even"], 6)


def label_margin(spark, d):
    """Every vector against each label's representative, the mean of all its vectors."""
    v = T(spark, d, "embeddings")
    ex = R.mean_vector(v, ["label"], "embedding").select(F.col("label").cast("long").alias("vec_id"), "embedding", "label")
    return R.label_margin(v, ex, "vec_id", "embedding", "label", 0.1, 0.02, with_own=True)


def mean_query_vector(spark, d):
    m = R.mean_vector(T(spark, d, "embeddings"), ["label"], "embedding")
    return m.select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def exchange_vectors(spark, d):
    """of each pair of neighbouring vectors (question, answer) the sum of the unit vectors."""
    v = T(spark, d, "embeddings")
    a = v.select(F.floor(F.col("vec_id") / 2).alias("pair"), F.col("embedding").alias("q")).where("vec_id % 2 = 0")
    b = v.select(F.floor(F.col("vec_id") / 2).alias("pair"), F.col("embedding").alias("a")).where("vec_id % 2 = 1")
    each = a.join(b, "pair").select("pair", F.posexplode(R.exchange_vector("q", "a")).alias("i", "x"))
    return each.select("pair", "i", F.round("x", 6).alias("x"))


def one_space(spark, d):
    """an index of one encoder passes; the query that finds another fails (tested)."""
    v = T(spark, d, "embeddings").withColumn("space", F.concat(F.lit("e"), F.size("embedding").cast("string")))
    own = v.agg(F.max("space")).first()[0]
    return R.require_one_space(v, F.col("space"), own or "e0").groupBy("space").agg(F.count(F.lit(1)).alias("n"))


def gated_methods(spark, d):
    """Of the candidates of one method only those with a rank by words or enough similarity."""
    v = T(spark, d, "embeddings").withColumn("method", F.element_at(F.array(*map(F.lit, ("text", "figure", "description"))), (F.col("label") % 3 + 1).cast("int")))
    some = R.of_methods(v, "method", ("text", "description"))
    near = R.cosine_scores(some, _vector_queries(spark, d), "vec_id", "embedding", "query_id", "q", least=R.GATE)
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("similarity"), 6).alias("best"))


def token_share(spark, d):
    doc = T(spark, d, "documents")
    asks = doc.select("source", "doc_id", (F.col("doc_id") % 50 == 0).alias("pinned"), K.page_cost(F.coalesce("text", F.lit(""))).alias("want"), F.lit(40).cast("bigint").alias("floor"))
    return K.share_budget(asks, ["doc_id"], "want", "floor", 4000, 0.25, ["source"])


def recent_history(spark, d):
    c = T(spark, d, "conversations").where("role in ('user', 'assistant') and trim(text) <> ''")
    return K.recent_within(c, ["conv_id"], "turn", F.length("text"), 900).select("conv_id", "turn", "running")


def page_ranges(spark, d):
    return K.page_ranges(T(spark, d, "labels").where("quality = 1"), ["toxic"], "doc_id")


def rank_ties(spark, d):
    return T(spark, d, "part").select("p_partkey", "p_brand", K.best_place("p_size", ["p_brand"]).alias("place"))


def avg_rank(spark, d):
    return T(spark, d, "part").select("p_partkey", "p_brand", K.average_rank("p_size", ["p_brand"]).alias("place"))


def _memory(spark, d):
    """Notes with a kind, a conversation and a vector; their number is their time."""
    return T(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("label") % 3 == 0, "profile").when(F.col("label") % 3 == 1, "preference").otherwise("fact").alias("kind"), (F.col("vec_id") % 7).cast("string").alias("conversation"))


def _notes(spark, d, least=None):
    """How near each note is to each question vector. What is known of a note goes along with its number, so pairs aren't joined."""
    v = _memory(spark, d).select(F.struct("vec_id", "kind", "conversation").alias("note"), "embedding")
    near = R.cosine_scores(v, _vector_queries(spark, d), "note", "embedding", "query_id", "q", least=least, with_own=True).where("note.vec_id <> query_id")
    return near.select("query_id", "note.*", F.round("similarity", 9).alias("similarity"))


def memory_relevant(spark, d):
    """The newest profile and preference notes and the most similar others, else the most recent ones."""
    v, q = _memory(spark, d), _vector_queries(spark, d)
    near = R.cosine_scores(v.where("kind = 'fact'"), q, "vec_id", "embedding", "query_id", "q", 8, 0.30).withColumn("similarity", F.round("similarity", 9))
    return K.relevant_notes(v, q, near, "query_id", "vec_id", "kind", "similarity").select("query_id", "vec_id", "kind")


def memory_recall(spark, d):
    """The three most similar notes of other conversations, at 0.40 or more."""
    n = _notes(spark, d, 0.40).where(F.col("conversation") != (F.col("query_id") % 7).cast("string"))
    return K.most_similar(n, ["query_id"], "similarity", "vec_id", 0.40, 3).select("query_id", "vec_id", "place", F.round("similarity", 6).alias("similarity"))


def trail_search(spark, d):
    """Notes at 0.62 or more by similarity, then by time; beside each the best similarity of its phrases (here its neighbours of the same label)."""
    v = T(spark, d, "embeddings")
    n = _notes(spark, d)
    phrases = n.groupBy("query_id", "kind").agg(F.max("similarity").alias("phrase"))
    return K.most_similar(n, ["query_id"], "similarity", "vec_id", 0.62, 5).join(phrases, ["query_id", "kind"]).join(v.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", "place", F.round("phrase", 6).alias("phrase"))


_NORM = "(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_COS = "SELECT * FROM (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) rank FROM (SELECT b.vec_id query_id, a.vec_id, round({n}, 9) s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE b.vec_id % 100 = 0)) WHERE rank <= {k}"
QUERIES = {
    "hybrid_search": (hybrid_search, f"{_HYBRID_SQL}, {_DIVERSE_SQL}, n AS (SELECT conv_id, substr(arg_min(text, turn), 1, 40) d FROM conversations GROUP BY 1) SELECT item_id, doc_id, source, row_number() OVER (PARTITION BY item_id ORDER BY fused_rank) AS place, round(score, 6) AS score, round(similarity, 6) AS similarity, d AS description FROM p LEFT JOIN n ON conv_id = doc_id WHERE pick <= 6"),
    "bm25_topk": (bm25_topk, f"WITH {_Q_SQL} SELECT item_id, doc_id, rank, round(b, 6) AS bm25 FROM (SELECT item_id, doc_id, b, row_number() OVER (PARTITION BY item_id ORDER BY b DESC, doc_id) rank FROM bm) WHERE rank <= 10"),
    "ranked_pages": (ranked_pages, f"{_HYBRID_SQL}, g AS (SELECT item_id, source, doc_id // 10 AS page, min(fused_rank) f FROM r WHERE fused_rank <= 60 GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY f) AS place FROM g) SELECT item_id, source, page, place FROM k WHERE place <= 20"),
    "unit_search": (unit_search, f"""{_PLANS_SQL}, h AS (SELECT r.item_id // 40 AS plan, r.item_id, r.doc_id, r.source, fused_rank, n_chars::DOUBLE AS second, min(fused_rank) OVER (PARTITION BY r.item_id, r.source) lead FROM r JOIN documents USING (doc_id) WHERE fused_rank <= 20),
g AS (SELECT *, dense_rank() OVER (PARTITION BY item_id ORDER BY lead) dk FROM h), s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN fused_rank = lead AND dk <= 3 THEN 0 ELSE 1 END, fused_rank) AS spread FROM g),
f AS (SELECT plan, doc_id, min((spread, item_id)) x FROM s GROUP BY 1, 2), i AS (SELECT plan, doc_id, x[1] AS spread, x[2] AS item_id, row_number() OVER (PARTITION BY plan ORDER BY x, doc_id) AS place FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY second DESC, doc_id) AS reranked FROM s) SELECT i.plan, i.item_id, doc_id, place, reranked FROM i JOIN c USING (item_id, doc_id) WHERE place <= 10"""),
    "exchange_vectors": (exchange_vectors, "WITH u AS (SELECT vec_id, vec_id // 2 AS pair, generate_subscripts(embedding, 1) - 1 i, unnest(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) x FROM embeddings) SELECT pair, i::INT AS i, round(sum(x), 6) AS x FROM u GROUP BY 1, 2 HAVING count(*) = 2"),
    "one_space": (one_space, "SELECT 'e' || len(embedding) AS space, count(*) AS n FROM embeddings GROUP BY 1"),
    "gated_methods": (gated_methods, f"SELECT b.vec_id AS query_id, count(*) AS n, round(max({_NORM}), 6) AS best FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE b.vec_id % 100 = 0 AND a.label % 3 <> 1 AND {_NORM} >= 0.3 GROUP BY 1"),
    "memory_recall": (memory_recall, f"SELECT query_id, vec_id, place, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS place FROM (SELECT b.vec_id query_id, a.vec_id, round({_NORM}, 9) s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE b.vec_id % 100 = 0 AND a.vec_id % 7 <> b.vec_id % 7) WHERE s >= 0.40) WHERE place <= 3"),
    "trail_search": (trail_search, f"WITH n AS (SELECT b.vec_id query_id, a.vec_id, a.label, CASE a.label % 3 WHEN 0 THEN 'profile' WHEN 1 THEN 'preference' ELSE 'fact' END k, round({_NORM}, 9) s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE b.vec_id % 100 = 0), p AS (SELECT *, max(s) OVER (PARTITION BY query_id, k) phrase FROM n) SELECT query_id, vec_id, label, place, round(phrase, 6) AS phrase FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS place FROM p WHERE s >= 0.62) WHERE place <= 5"),
    "rrf_fusion": (rrf_fusion, f"{_HYBRID_SQL} SELECT item_id, doc_id, fused_rank, round(score, 6) AS score FROM r WHERE fused_rank <= 20"),
    "source_diversity": (source_diversity, f"{_HYBRID_SQL}, h AS (SELECT *, min(fused_rank) OVER (PARTITION BY item_id, source) lead FROM r WHERE fused_rank <= 30), g AS (SELECT *, dense_rank() OVER (PARTITION BY item_id ORDER BY lead) dk FROM h) SELECT item_id, doc_id, source, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN fused_rank = lead AND dk <= 4 THEN 0 ELSE 1 END, fused_rank) AS place FROM g"),
    "page_rerank": (page_rerank, f"{_HYBRID_SQL}, t AS (SELECT r.*, n_chars::DOUBLE AS second, row_number() OVER (PARTITION BY item_id, r.source ORDER BY fused_rank) k FROM r JOIN documents USING (doc_id) WHERE fused_rank <= 60), b AS (SELECT item_id, source, max(second) AS best_score, min(fused_rank) AS first_rank FROM t WHERE k <= 2 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY best_score DESC, first_rank) AS place FROM b"),
    "interleave": (interleave, f"{_PLANS_SQL}, l AS (SELECT item_id // 40 AS plan, doc_id, min((fused_rank, item_id)) f FROM r WHERE fused_rank <= 10 GROUP BY 1, 2) SELECT plan, doc_id, place FROM (SELECT plan, doc_id, row_number() OVER (PARTITION BY plan ORDER BY f, doc_id) AS place FROM l) WHERE place <= 12"),
    "term_mentions": (term_mentions, r"WITH h AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')) term FROM documents), c AS (SELECT term, source, count(*) AS n_places, list_sort(list(doc_id))[1:12] AS places FROM h WHERE term IN ('license', 'the', 'idiot', 'version') GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n_places DESC, source) AS place FROM c) WHERE place <= 8"),
    "phrase_match": (phrase_match, r"WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), '  ') || ' ' s FROM documents) SELECT doc_id, ((length(s) - length(replace(s, ' general  public  license ', ''))) / length(' general  public  license '))::INT AS n_hits FROM w WHERE contains(s, ' general  public  license ')"),
    "prefix_match": (prefix_match, r"SELECT doc_id, n_hits FROM (SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda x: starts_with(x, 'licens')))::INT AS n_hits FROM documents) WHERE n_hits > 0"),
    "cosine_topk": (cosine_topk, "SELECT query_id, vec_id, rank, round(s, 6) AS similarity FROM (" + _COS.format(n=_NORM, k=5) + ")"),
    "retrieval_eval": (retrieval_eval, "WITH h AS (SELECT c.query_id, c.rank, a.label, b.label AS asked, (c.query_id % 200 = 0)::INT AS even FROM (" + _COS.format(n=_NORM, k=6) + ") c JOIN embeddings a ON a.vec_id = c.vec_id JOIN embeddings b ON b.vec_id = c.query_id), e AS (SELECT query_id, asked, even, min(rank) FILTER (label = asked) f, count(DISTINCT label) t FROM h GROUP BY ALL) SELECT asked, even, count(*) AS n, count(f) AS hits, round(count(f) / count(*), 6) AS rate, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(t), 6) AS mean_titles FROM e GROUP BY GROUPING SETS ((), (asked), (even))"),
    "label_margin": (label_margin, "WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) x FROM embeddings), m AS (SELECT label, i, avg(x) x FROM u GROUP BY 1, 2), c AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) x FROM m), s AS (SELECT vec_id, c.label, round(sum(u.x * c.x), 9) s FROM u JOIN c USING (i) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label DESC) k FROM s), p AS (SELECT vec_id, max(s) FILTER (k = 1) s1, coalesce(max(s) FILTER (k = 2), -1) s2, max(label) FILTER (k = 1) l FROM r GROUP BY 1) SELECT vec_id, CASE WHEN s1 >= 0.1 AND s1 - s2 >= 0.02 THEN l END AS chosen, round(s1, 6) AS best, round(s1 - s2, 6) AS lead FROM p"),
    "mean_query_vector": (mean_query_vector, "WITH u AS (SELECT label, generate_subscripts(embedding, 1) - 1 i, unnest(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) x FROM embeddings), m AS (SELECT label, i, avg(x) x FROM u GROUP BY 1, 2) SELECT label, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m"),
    "token_share": (token_share, "WITH a AS (SELECT source, doc_id, doc_id % 50 = 0 AS pinned, 15 + ceil(length(coalesce(text, '')) / 3)::BIGINT AS want, 40::BIGINT AS floor FROM documents), s AS (SELECT *, CASE WHEN pinned THEN want ELSE 0 END AS s1, CASE WHEN pinned THEN 0 ELSE least(floor, want) END AS s2, CASE WHEN pinned THEN 0 ELSE greatest(least(want, 1000) - least(floor, want), 0) END AS s3, CASE WHEN pinned THEN 0 ELSE want - least(floor, want) - greatest(least(want, 1000) - least(floor, want), 0) END AS s4 FROM a), b AS (SELECT *, coalesce(sum(s1) OVER w, 0) b1, coalesce(sum(s2) OVER w, 0) b2, coalesce(sum(s3) OVER w, 0) b3, coalesce(sum(s4) OVER w, 0) b4, sum(s1) OVER v t1, sum(s2) OVER v t2, sum(s3) OVER v t3 FROM s WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY source)), c AS (SELECT *, least(t1, 4000) x1, least(least(t1, 4000) + t2, 4000) x2, least(least(least(t1, 4000) + t2, 4000) + t3, 4000) x3 FROM b) SELECT source, doc_id, pinned, want, floor, (greatest(least(s1, 4000 - b1), 0) + greatest(least(s2, 4000 - x1 - b2), 0) + greatest(least(s3, 4000 - x2 - b3), 0) + greatest(least(s4, 4000 - x3 - b4), 0))::BIGINT AS granted FROM c"),
    "recent_history": (recent_history, "SELECT conv_id, turn, running FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE running <= 900"),
    "page_ranges": (page_ranges, "SELECT toxic, min(doc_id) AS first_page, max(doc_id) AS last_page FROM (SELECT toxic, doc_id, doc_id - row_number() OVER (PARTITION BY toxic ORDER BY doc_id) g FROM (SELECT DISTINCT toxic, doc_id FROM labels WHERE quality = 1)) GROUP BY toxic, g"),
    "rank_ties": (rank_ties, "SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS place FROM part"),
    "avg_rank": (avg_rank, "SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS place FROM part"),
    "memory_relevant": (memory_relevant, f"WITH n AS (SELECT b.vec_id query_id, a.vec_id, CASE a.label % 3 WHEN 0 THEN 'profile' WHEN 1 THEN 'preference' ELSE 'fact' END kind, round({_NORM}, 9) s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE b.vec_id % 100 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY vec_id DESC) r, row_number() OVER (PARTITION BY query_id, kind ORDER BY s DESC, vec_id DESC) c, count(*) FILTER (s >= 0.3) OVER (PARTITION BY query_id, kind) g FROM n) SELECT query_id, vec_id, kind FROM o WHERE (kind = 'profile' AND r <= 15) OR (kind = 'preference' AND r <= 10) OR (kind = 'fact' AND ((g > 0 AND s >= 0.3 AND c <= 8) OR (g = 0 AND r <= 8)))"),
}
