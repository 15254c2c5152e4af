"""Queries of the text operators over documents, conversations and events, with SQL where the dialects agree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import retrieval as R
from ..functions import text as X
from ..operators import reading as G
from ..storage import staged
from ..storage import table as T

HEADING = r"^[A-Z][a-z]+ [a-z]+\.$"


def _docs(spark, d):
    return T(spark, d, "documents").where("text is not null")


def markdown_sections(spark, d):
    return X.sections(_docs(spark, d), "doc_id", "text", HEADING).select("doc_id", "section", "first_line", "last_line", F.md5("body").alias("digest"))


def json_leaves(spark, d):
    """The events' properties within an object, an array and names that pointers escape."""
    whole = F.concat(F.lit('{"a/b": ['), "props", F.lit(', {"x~y": ['), F.col("event_id").cast("string"), F.lit(", null, {}]}], \"t\": "), F.when(F.col("event_id") % 2 == 0, F.lit('"é \\" x"')).otherwise("true"), F.lit("}"))
    return X.json_leaves(T(spark, d, "events").select("event_id", whole.alias("j")), "event_id", "j")


def running_headers(spark, d):
    return X.edge_patterns(_docs(spark, d).withColumn("series", F.col("doc_id") % 10), "series", "doc_id", "text", share=0.05)


def header_tracking(spark, d):
    lines = T(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") + F.when(F.col("conv_id") % 2 == 0, 7).otherwise(F.col("turn") % 2)).alias("k"))
    return X.tracks_pages(lines, ["conv_id"], "turn", "k", least=3)


def chunk_dedup(spark, d):
    lines = X.lines_of(_docs(spark, d), "doc_id", "text").where("trim(line) <> ''")
    return X.first_chunks(lines, "doc_id", "line_no", "line").select("doc_id", "line_no", "n_copies")


def subject_terms(spark, d):
    return T(spark, d, "benchmark").select("item_id", F.array_join(X.subject_terms(R.words(F.col("text")), R.STOP_WORDS), " ").alias("terms"))


def fixed_windows(spark, d):
    w = _docs(spark, d).select("doc_id", F.posexplode(X.fixed_windows(F.split(F.trim("text"), r"\s+"), 110, 90)).alias("k", "w"))
    return w.select("doc_id", "k", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


def sentence_chunks(spark, d):
    c = _docs(spark, d).select("doc_id", F.posexplode(X.packed("text", F.lit(110))).alias("k", "c"))
    return c.select("doc_id", "k", "c.start", "c.end", "c.tokens")


def sentence_spans(spark, d):
    """The sentences of every document as [start, end), and how many they are; a null text has none."""
    spans = T(spark, d, "documents").select("doc_id", X.sentences(F.coalesce("text", F.lit(""))).alias("spans"))
    return spans.select("doc_id", F.size("spans").alias("n_sentences"), "spans")


def _with_references(spark, d):
    """Documents with a planted list: a title, four numbered entries (one of two lines), and for some of them other lines after it."""
    k = F.col("doc_id")
    tail = F.when(k % 3 == 0, F.array_join(F.array_repeat(F.lit("plain words without an entry"), 9), "\n")).when(k % 3 == 1, "1. another list begins").otherwise("")
    own = F.concat(F.lit("before\nReferences\n[1] Silva, J. A title\nand its end, 2019, pp. 3-9\n[2] Costa, A.\n[3] Lima, B.\n"), F.when(k % 5 == 0, "").otherwise("[4] Reis, C.\n"), tail)
    return T(spark, d, "documents").select("doc_id", own.alias("text"))


def reference_regions(spark, d):
    return X.reference_regions(_with_references(spark, d), "doc_id", "text")


def contents_pages(spark, d):
    """Of every document its text, and for some of them planted lines with leaders before it."""
    k = F.col("doc_id")
    lead = F.array_join(F.array_repeat(F.concat(F.lit("Chapter of words "), F.repeat(F.lit(". "), 8), F.lit("12")), 6), "\n")
    t = F.when(k % 3 == 0, lead).when(k % 3 == 1, F.concat(lead, F.lit("\n"), F.array_join(F.array_repeat(F.lit("a line"), 12), "\n"))).otherwise(F.col("text"))
    return T(spark, d, "documents").where("text is not null").select("doc_id", X.is_contents(t).alias("is_contents"))


def glyph_codes(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.without_glyphs(F.col("text"))).alias("digest"))


def folded_text(spark, d):
    return T(spark, d, "benchmark").select("item_id", X.squash(X.plain("text")).alias("squashed"))


def conversation_pairs(spark, d):
    """Consecutive user and assistant messages."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = T(spark, d, "conversations").where("role in ('user', 'assistant')").withColumn("r", F.lead("role").over(w)).withColumn("a", F.lead("text").over(w))
    return c.where("role = 'user' and r = 'assistant'").select("conv_id", "turn", F.length("text").alias("question"), F.length("a").alias("answer"))


def conversation_list(spark, d):
    """Conversations with their messages counted, the newest turn, and blank ones left out."""
    return T(spark, d, "conversations").where("trim(text) <> ''").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("last_turn"))


def note_names(spark, d):
    return X.note_names(T(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").select("c_custkey", "note_name")


def _lines_and_hits(spark, d):
    chunks = X.lines_of(_docs(spark, d), "doc_id", "text").withColumnRenamed("line", "text")
    chunks = chunks.withColumn("line_no", F.col("line_no").cast("long"))
    hits = chunks.where(F.length("text") % 4 == 0).select("doc_id", "line_no", F.row_number().over(_by_length()).cast("long").alias("rank"))
    return chunks, hits


def passages(spark, d):
    chunks, hits = _lines_and_hits(spark, d)
    return X.passages(hits, chunks, "doc_id", "line_no", "rank").select("doc_id", "rank", "first", "last", F.md5("passage").alias("passage"))


def overlap_passages(spark, d):
    """Fixed windows of words, which share their ends, joined again."""
    w = _docs(spark, d).select("doc_id", F.posexplode(X.fixed_windows(F.split(F.trim("text"), r"\s+"), 40, 30)).alias("k", "w"))
    chunks = w.select("doc_id", F.col("k").cast("long").alias("k"), F.array_join("w", " ").alias("text"))
    hits = chunks.where("k % 4 = 1").select("doc_id", "k", F.floor(F.col("k") / 4).alias("rank"))
    return X.passages(hits, chunks, "doc_id", "k", "rank", fixed=True).select("doc_id", "rank", "first", "last", F.md5("passage").alias("passage"))


def _by_length():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "line_no")


def _reading(spark, d):
    """Documents of a source as one plan, by number, with blocks of two lines and what a word finds in them."""
    from ..operators import ranking as K

    pages = X.lines_of(_docs(spark, d), "doc_id", "text").withColumn("block", F.floor((F.col("line_no") - 1) / 2))
    blocks = pages.groupBy("doc_id", "block").agg(F.sum(K.page_cost(F.col("line"))).cast("long").alias("cost"), F.min(F.when(F.col("line").contains("the"), F.col("line_no"))).alias("found_rank"))
    documents = T(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("position"), (F.col("doc_id") % 97 == 0).alias("pinned"))
    return documents, blocks.join(documents.select("doc_id", "source"), "doc_id")


def reading_selection(spark, d):
    """The blocks of pinned and found documents of each source within one budget."""
    documents, blocks = _reading(spark, d)
    return G.selected_blocks(documents, staged(blocks, "blocks"), "source", "doc_id", "position", 2500)


def page_picks(spark, d):
    """Of each source the first blocks by rank that still fit behind the documents pinned, twelve at most."""
    documents, blocks = _reading(spark, d)
    blocks = staged(blocks.withColumnRenamed("block", "page"), "blocks")
    pinned = blocks.join(documents.where("pinned").select("doc_id"), "doc_id").groupBy("source", "doc_id").agg(F.sum("cost").alias("tokens"))
    wanted = blocks.where("found_rank is not null").withColumn("priority", F.struct("found_rank", "doc_id", "page"))
    lead = wanted.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("priority"))).where(F.col("_r") <= 200).drop("_r")  # a search's pool
    return G.picked_pages(lead, blocks.drop("found_rank"), pinned, "source", "doc_id", "page", "priority", 2500)


def reading_plan(spark, d):
    """Allowances by source, then the blocks of each document that fit."""
    from ..operators import ranking as K

    pages = X.lines_of(_docs(spark, d), "doc_id", "text").withColumn("block", F.floor((F.col("line_no") - 1) / 2))
    blocks = pages.groupBy("doc_id", "block").agg(F.sum(K.page_cost(F.col("line"))).cast("double").alias("cost"), F.min(F.when(F.col("line").contains("the"), F.col("line_no"))).cast("double").alias("found"))
    totals = blocks.groupBy("doc_id").agg(F.sum("cost").cast("bigint").alias("want"), F.min("cost").cast("bigint").alias("floor"))
    asks = totals.join(T(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("pinned", F.col("doc_id") % 97 == 0)
    share = K.share_budget(asks, ["doc_id"], "want", "floor", 2500, 0.25, ["source"]).select("doc_id", F.col("granted").cast("double").alias("granted"))
    return X.fitting_blocks(blocks.join(share, "doc_id"), "doc_id", "block", "cost", "found", "granted")


_W = r"[\p{L}\p{N}]+"
QUERIES = {
    "markdown_sections": (markdown_sections, "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n FROM documents WHERE text IS NOT NULL), s AS (SELECT *, sum(regexp_matches(line, '" + HEADING + "')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l), b AS (SELECT doc_id, section, min(n) AS first_line, max(n) AS last_line, string_agg(line, chr(10) ORDER BY n) body FROM s GROUP BY 1, 2) SELECT doc_id, section, first_line, last_line, md5(body) AS digest FROM b WHERE section > 0 OR trim(body) <> ''"),
    "json_leaves": (json_leaves, """SELECT event_id, '/a~1b/0/' || k AS pointer, (props::JSON ->> k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) k FROM events)
UNION ALL SELECT event_id, '/a~1b/1/x~0y/0', event_id::VARCHAR FROM events UNION ALL SELECT event_id, '/a~1b/1/x~0y/1', 'null' FROM events UNION ALL SELECT event_id, '/t', CASE WHEN event_id % 2 = 0 THEN '"é \\" x"' ELSE 'true' END FROM events"""),
    "running_headers": (running_headers, r"WITH f AS (SELECT doc_id % 10 AS series, doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') l FROM documents WHERE text IS NOT NULL), e AS (SELECT DISTINCT series, doc_id, regexp_replace(regexp_replace(trim(lower(line)), '\s+', ' ', 'g'), '\d+', '#', 'g') AS pattern FROM (SELECT series, doc_id, unnest(l[1:3] || CASE WHEN len(l) > 3 THEN l[greatest(len(l) - 2, 1):len(l)] ELSE [] END) line FROM f)), n AS (SELECT series, count(*) AS n_pages FROM f GROUP BY 1), c AS (SELECT series, pattern, count(*) AS n_seen FROM e WHERE NOT regexp_matches(pattern, '^(fig|tab|quadro|gr[áa]fico)\w*\.?\s*#') AND (regexp_matches(pattern, '\p{L}') OR length(regexp_replace(pattern, '[^#]', '', 'g')) <= 2) GROUP BY 1, 2) SELECT series, pattern, n_seen, n_pages FROM c JOIN n USING (series) WHERE n_pages >= 4 AND n_seen >= greatest(3, ceil(0.05 * n_pages))"),
    "header_tracking": (header_tracking, "WITH x AS (SELECT conv_id, turn, turn + CASE WHEN conv_id % 2 = 0 THEN 7 ELSE turn % 2 END k FROM conversations), p AS (SELECT conv_id, lead(turn) OVER w - turn dp, lead(k) OVER w - k dn FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT conv_id, count(*) n, count(*) FILTER (dp <= 4) AS pairs, count(*) FILTER (dp <= 4 AND dp = dn) AS hits FROM p GROUP BY 1) SELECT conv_id, pairs, hits FROM g WHERE n >= 3 AND pairs >= 2 AND hits >= 0.6 * pairs"),
    "chunk_dedup": (chunk_dedup, r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n FROM documents WHERE text IS NOT NULL) SELECT doc_id, min(n)::INT AS line_no, count(*) AS n_copies FROM l WHERE trim(line) <> '' GROUP BY doc_id, trim(regexp_replace(line, '\s+', ' ', 'g'))"),
    "subject_terms": (subject_terms, r"WITH t AS (SELECT item_id, unnest(ws) w, generate_subscripts(ws, 1) p FROM (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') ws FROM benchmark)), f AS (SELECT item_id, w, min(p) p FROM t WHERE length(w) >= 4 AND w NOT IN (" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + ") GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p) k FROM f) SELECT item_id, coalesce(string_agg(w, ' ' ORDER BY k) FILTER (k <= 6), '') AS terms FROM r GROUP BY 1"),
    "fixed_windows": (fixed_windows, r"WITH t AS (SELECT doc_id, string_split_regex(trim(text, ' '), '\s+') w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 90)) s FROM t) SELECT doc_id, (s // 90)::INT AS k, len(w[s + 1:s + 110])::INT AS n, md5(array_to_string(w[s + 1:s + 110], ' ')) AS digest FROM s WHERE s = 0 OR s + 20 < len(w)"),
    "sentence_chunks": (sentence_chunks, None),
    "sentence_spans": (sentence_spans, None),
    "reference_regions": (reference_regions, "SELECT doc_id, 2 AS start, CASE WHEN doc_id % 5 = 0 THEN 6 ELSE 7 END + 0 AS \"end\" FROM documents"),
    "overlap_passages": (overlap_passages, None),
    "contents_pages": (contents_pages, "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') l FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, len(l) n, len(list_filter(l, lambda x: regexp_matches(x, '\\.(\\s?\\.){5,}|…(\\s?…){2,}'))) k FROM l) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE k >= 5 AND k >= 0.4 * n END AS is_contents FROM h"),
    "glyph_codes": (glyph_codes, r"SELECT doc_id, md5(regexp_replace(text, '(?:/gid\d+)+', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL"),
    "folded_text": (folded_text, r"SELECT item_id, regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]', '', 'g') AS squashed FROM benchmark"),
    "conversation_pairs": (conversation_pairs, "SELECT conv_id, turn, length(text)::INT AS question, length(a)::INT AS answer FROM (SELECT *, lead(role) OVER w r, lead(text) OVER w a FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'"),
    "conversation_list": (conversation_list, "SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn FROM conversations WHERE trim(text) <> '' GROUP BY 1"),
    "note_names": (note_names, "SELECT c_custkey, CASE WHEN k = 1 THEN c_mktsegment ELSE c_mktsegment || ' (' || k || ')' END AS note_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) k FROM customer)"),
    "passages": (passages, None),
    "reading_plan": (reading_plan, None),
    "reading_selection": (reading_selection, None),
    "page_picks": (page_picks, None),
}
