"""Lexical and vector retrieval."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged

# Words left out of queries, folded, in Portuguese and in English.
PORTUGUESE = """
a ao aos as ate com como contra da das de dela dele deles do dos e ela elas ele eles em entre era
essa essas esse esses esta estas este estes eu foi foram ha isso isto ja la lhe mais mas me mesmo
meu minha muito na nas nem no nos nossa nosso num numa o os ou para pela pelas pelo pelos por qual
quais quando que quem se sem ser seu seus sua suas sao so tambem te tem ter um uma umas uns voce
voces sobre segundo conforme onde porque qual quanto quanta quantos quantas cujo cuja ha sera
seria sido sendo estao esta estava estavam fazer faz feito pode podem deve devem via cada outro
outra outros outras todo toda todos todas apos antes depois ainda assim entao aqui ali
"""
ENGLISH = """
a about above after again against all am an and any are as at be because been before being below
between both but by can could did do does doing down during each few for from further had has
have having he her here hers herself him himself his how i if in into is it its itself just me
more most my myself no nor not now of off on once only or other our ours ourselves out over own
same she should so some such than that the their theirs them themselves then there these they
this those through to too under until up very was we were what when where which while who whom
why will with would you your yours yourself yourselves according whose
"""
STOP_WORDS = tuple(dict.fromkeys((PORTUGUESE + ENGLISH).split()))
K1, B = 1.2, 0.75
#: Queries scored against all rows at once, and the bytes that their vectors or weights may take in a task.
BLOCK, BLOCK_BYTES = 2048, 64 << 20
#: Fusion: the base, and the weights of meaning, words and named documents. Candidates by meaning alone need this similarity.
BASE, MEANING, WORDS, NAMED, GATE = 60, 1.0, 0.5, 1.0, 0.30


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and their base letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


_MARKED, _BASE = _plain_letters()


def folded(text: Column) -> Column:
    """Lower case, composed Latin letters without their marks; null is empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKED, _BASE)


def words(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order. Only words that aren't ASCII are folded letter by letter."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))
    return F.transform(found, lambda w: F.when(F.octet_length(w) > F.length(w), F.translate(w, _MARKED, _BASE)).otherwise(w))


def query_terms(text: Column, most: int = 40) -> Column:
    """U-S1, T02: distinct words that aren't stop words, in order, `most` at most."""
    return F.slice(F.array_except(F.array_distinct(words(text)), F.array(*map(F.lit, STOP_WORDS))), 1, most)


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf) of every document."""
    return docs.select(doc, F.explode(words(F.col(text))).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, doc: str, text: str, query: str, terms: str) -> DataFrame:
    """(query, doc, bm25) of every document that holds a term, larger is better. Statistics are over all documents.

    The texts are read once: of each only its length and those of its words that some query asks for are kept. queries: a
    workload's questions with an array of distinct terms, so their words are few.
    """
    asked = queries.select(query, F.explode(terms).alias("term")).distinct()
    wanted = sorted(r[0] for r in asked.distinct().select("term").distinct().collect())  # a workload's distinct words
    # The words are letters and digits, so they stand in the expression as they are; it becomes a look-up in one hash set.
    some = "filter(_w, x -> x IN (" + ", ".join(f"'{x}'" for x in wanted or [""]) + "))"
    counted = staged(docs.select(doc, text).select(doc, words(F.col(text)).alias("_w")).select(doc, F.size("_w").alias("_len"), F.expr(some).alias("_hit")), "postings")
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg")).first()
    df = {r[0]: r[1] for r in counted.select(F.explode(F.array_distinct("_hit")).alias("t")).groupBy("t").count().collect()}  # a workload's words
    terms = sorted(df)
    place = {t: k for k, t in enumerate(terms)}
    by_query: dict = {}
    for q, t in asked.collect():
        by_query.setdefault(q, []).append(place.get(t, -1))
    idf = np.log((total["n"] - np.array([df[t] for t in terms], float) + 0.5) / (np.array([df[t] for t in terms], float) + 0.5))
    idf = np.where(idf <= 0, 1e-6, idf)
    kinds = {f.name: f.dataType.simpleString() for f in [*docs.schema.fields, *queries.schema.fields]}
    schema = f"`{query}` {kinds[query]}, `{doc}` {kinds[doc]}, bm25 double"
    names, out = sorted(by_query), None
    # Blocks of queries of bounded size; each is sent to all tasks as a matrix of words by queries.
    step = max(1, BLOCK_BYTES // (8 * max(1, len(terms))))
    for first in range(0, len(names), step):
        some = names[first : first + step]
        weight = np.zeros((len(terms), len(some)))
        for j, q in enumerate(some):
            own = [k for k in by_query[q] if k >= 0]
            weight[own, j] = idf[own]
        shared = docs.sparkSession.sparkContext.broadcast((some, terms, weight, float(total["avg"] or 1.0)))
        part = counted.where(F.size("_hit") > 0).mapInArrow(_scorer(shared, query, doc, kinds[query]), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _scorer(shared, query: str, doc: str, kind: str):
    """Documents (doc, length, asked words) by block: their saturated term frequencies times the block's weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, weight, mean = shared.value
        value_set, own = pa.array(terms, pa.string()), pa.array(names, _arrow(kind))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                n = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(b.num_rows), n)
                term = pc.index_in(b.column(2).flatten(), value_set=value_set).to_numpy(zero_copy_only=False).astype(np.int64)
                pair, tf = np.unique(owner * len(terms) + term, return_counts=True)
                d, t = pair // len(terms), pair % len(terms)
                size = b.column(1).to_numpy().astype(float)[d]
                dense = np.zeros((b.num_rows, len(terms)))
                dense[d, t] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
                score = dense @ weight
                x, y = np.nonzero(score > 0)
                yield pa.RecordBatch.from_arrays([own.take(pa.array(y)), b.column(0).take(pa.array(x)), pa.array(score[x, y])], names=[query, doc, "bm25"])

    return run


def prefix_hits(docs: DataFrame, doc: str, text: str, prefix: str) -> DataFrame:
    """documents with a word that starts with `prefix`, and how many such words."""
    n = F.size(F.filter(words(F.col(text)), lambda w: w.startswith(prefix)))
    return docs.select(doc, n.alias("n_hits")).where("n_hits > 0")


def phrase_hits(docs: DataFrame, doc: str, text: str, phrase: list[str]) -> DataFrame:
    """how often the words of a phrase stand next to each other."""

    def hits(w: Column) -> Column:
        def here(i: Column) -> Column:
            found = F.lit(True)
            for k, x in enumerate(phrase):
                found = found & (F.get(w, i + k) == x)
            return found

        return F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - len(phrase), F.lit(0))), here))

    # A cheap test in the scan keeps the positional one to texts that hold the first and the last word at all.
    some = docs.where(F.lower(F.col(text)).contains(phrase[0]) & F.lower(F.col(text)).contains(phrase[-1]))
    # The words are bound to a variable: named within the filter, they would be cut anew at every place.
    count = F.get(F.transform(F.array(words(F.col(text))), hits), F.lit(0))
    return some.select(doc, count.alias("n_hits")).where("n_hits > 0")


def term_mentions(docs: DataFrame, terms: list[str], doc: str, text: str, group: str, pages: int = 12, top: int = 8) -> DataFrame:
    """Per term and group the number of distinct documents that hold it and the first ids, and the groups with most of them."""
    # Staged, as it is read twice and the texts are cut into words once.
    held = staged(docs.select(doc, group, F.explode(F.array_intersect(words(F.col(text)), F.array(*map(F.lit, terms)))).alias("term")), "mentions")
    counted = held.groupBy("term", group).agg(F.count(F.lit(1)).alias("n_places"))
    best = counted.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n_places"), group))).where(F.col("place") <= top)
    # Of a term and group only the first ids are gathered: the rank limits them before the shuffle.
    first = held.withColumn("_r", F.row_number().over(Window.partitionBy("term", group).orderBy(doc))).where(F.col("_r") <= pages)
    places = first.groupBy("term", group).agg(F.sort_array(F.collect_list(doc)).alias("places"))
    return best.join(places, ["term", group]).select("term", group, "n_places", "places", "place")


def dot(a: str, b: str) -> Column:
    """Inner product of two array columns, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: str) -> Column:
    """The vector brought to length one."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / n)




def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows of that many components, in double, and the rows' places. Null, zero or odd vectors take no part."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim) if len(at) else np.zeros((0, dim))
    norm = np.sqrt((flat * flat).sum(1)) if len(at) else np.zeros(0)
    good = np.isfinite(norm) & (norm > 0)
    return flat[good] / norm[good, None], at[good]


#: Pairs that a task holds at once.
CELLS = 1 << 19


def cosine_scores(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, qvector: str, k: int | None = None, least: float | None = None, with_own: bool = False) -> DataFrame:
    """(query, key, similarity) of all pairs (but a query's own key unless with_own), or of the k best of each batch of rows (k) or those of at least `least`.

    The queries are the stated workload; they are taken in blocks of bounded size, each sent to all tasks.
    """
    spark, blocks = vectors.sparkSession, max(1, -(-queries.count() // BLOCK))
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema.fields, *queries.schema.fields]}
    schema = f"`{query}` {kinds[query]}, `{key}` {kinds[key]}, similarity double"

    def scored(part: DataFrame) -> DataFrame | None:
        some = [(r[0], np.array(r[1], float)) for r in part.select(query, qvector).where(F.col(qvector).isNotNull()).collect()]
        some = sorted(((i, x / np.sqrt(x @ x)) for i, x in some if np.isfinite(x).all() and x.any()), key=lambda x: (len(x[1]), x[0]))
        if not some:
            return None
        dim = len(some[0][1])
        if any(len(x) != dim for _, x in some):
            raise ValueError("queries are of several dimensions: they come from several encoders")
        matrix = np.array([x for _, x in some])
        if matrix.nbytes > BLOCK_BYTES:
            raise ValueError("a block of queries is too large; lower BLOCK")
        shared = spark.sparkContext.broadcast(([i for i, _ in some], matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            asked = pa.array(names, _arrow(kinds[query]))
            step = max(1, CELLS // len(names))
            for b in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
                v, at = _matrix(b.column(1), dim)
                if not len(at):
                    continue
                own = b.column(0).take(pa.array(at))
                s = np.einsum("qd,nd->qn", q, v)
                ids = [] if with_own else own.to_pylist()
                place = {} if with_own else {x: j for j, x in enumerate(ids)}
                for j, name in enumerate(() if with_own else names):
                    if name in place:
                        s[j, place[name]] = -np.inf
                keep = s > -np.inf
                if least is not None:
                    keep &= s >= least - 1e-9
                if k is not None and s.shape[1] > k:
                    bound = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    keep &= s >= bound[:, None] - 1e-9  # all that rounding may bring among the k best
                x, y = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(x)), own.take(pa.array(y)), pa.array(s[x, y])], names=[query, key, "similarity"])

        return vectors.select(key, vector).mapInArrow(run, schema)

    whole = None
    for n in range(blocks):
        got = scored(queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == n) if blocks > 1 else queries)
        whole = got if whole is None else whole.unionByName(got) if got is not None else whole
    return whole if whole is not None else spark.createDataFrame([], schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def cosine_top(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, qvector: str, k: int, least: float | None = None, digits: int = 9) -> DataFrame:
    """The k nearest vectors of each query by cosine (rounded), at least `least`; ties go to the smaller key."""
    near = cosine_scores(vectors, queries, key, vector, query, qvector, k, least).withColumn("similarity", F.round("similarity", digits))
    near = near.where(F.col("similarity") >= least) if least is not None else near
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("similarity"), key))).where(F.col("rank") <= k)


def label_margin(vectors: DataFrame, examples: DataFrame, key: str, vector: str, label: str, least: float, margin: float, with_own: bool = False) -> DataFrame:
    """the label of the most similar example, if similar enough and ahead of the next label. Each vector gets the labels' best similarities."""
    ex = examples.select(F.col(key).alias("_k"), F.col(vector).alias("_e"), F.col(label).alias("_l"))
    pairs = cosine_scores(vectors, ex, key, vector, "_k", "_e", with_own=with_own)
    best = pairs.join(ex.select("_k", "_l"), "_k").groupBy(key, "_l").agg(F.round(F.max("similarity"), 9).alias("_s"))
    ranked = best.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("_s", "_l")), False), 1, 2).alias("_t"))  # as many as there are labels
    lead = F.col("_t")[0]["_s"] - F.coalesce(F.get("_t", F.lit(1))["_s"], F.lit(-1.0))
    return ranked.select(key, F.when((F.col("_t")[0]["_s"] >= least) & (lead >= margin), F.col("_t")[0]["_l"]).alias("chosen"), F.round(F.col("_t")[0]["_s"], 6).alias("best"), F.round(lead, 6).alias("lead"))


def exchange_vector(question: str, answer: str) -> Column:
    """the sum of a question's and an answer's unit vectors."""
    return F.zip_with(unit(question), unit(answer), lambda x, y: x + y)


def require_one_space(chunks: DataFrame, space: Column, own: str) -> DataFrame:
    """the chunks, after a check that all their vectors come from the encoder `own`."""
    other = chunks.select(space.alias("s")).where(~F.col("s").eqNullSafe(F.lit(own))).limit(1).count()
    if other:
        raise ValueError("the encoder of the index has changed; encode the documents again")
    return chunks


def of_methods(chunks: DataFrame, method: str, methods: tuple[str, ...]) -> DataFrame:
    """Chunks that were made by one of the methods (text, caption, description ...)."""
    return chunks.where(F.col(method).isin(*methods))


def mean_vector(rows: DataFrame, per: list[str], vector: str) -> DataFrame:
    """the mean of unit vectors, brought to length one, as one array per group. One average a component, combined map-side."""
    dim = rows.agg(F.max(F.size(vector))).first()[0] or 0
    whole = rows.select(*per, unit(vector).alias("_u")).groupBy(*per).agg(*[F.avg(F.get("_u", F.lit(i))).alias(f"_x{i}") for i in range(dim)])
    mean = F.filter(F.array(*[F.col(f"_x{i}") for i in range(dim)]), lambda x: x.isNotNull()) if dim else F.array().cast("array<double>")
    return whole.select(*per, mean.alias("_m")).select(*per, unit("_m").alias(vector))


def retrieval_summary(hits: DataFrame, query: str, relevant: str, rank: str, title: str, dims: list[str], top: int) -> DataFrame:
    """Hits in the first `top`, rate, MRR and mean distinct titles: overall and by each dimension (grouping sets)."""
    each = hits.where(F.col(rank) <= top).groupBy(query, *dims).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("_first"), F.countDistinct(title).alias("_t"))
    stats = [F.count(F.lit(1)).alias("n"), F.count("_first").alias("hits"), F.round(F.count("_first") / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg(F.coalesce(1 / F.col("_first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("_t"), 6).alias("mean_titles")]
    return each.groupingSets([[], *[[F.col(x)] for x in dims]], *dims).agg(*stats)
