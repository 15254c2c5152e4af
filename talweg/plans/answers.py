"""Queries of answers, plans of research, routing and figures over the driver's tables: texts with planted content, and SQL that derives what must be found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import numbers as N
from ..functions import planning as P
from ..functions import routing as R
from ..functions import text as X
from ..storage import table as T


def number_extract(spark, d):
    lines = X.lines_of(T(spark, d, "documents").where("text is not null"), "doc_id", "text").where(N.has_digits(F.col("line")))
    each = lines.select("doc_id", "line_no", F.posexplode(N.numbers(F.col("line"))).alias("k", "number"))
    return each.select("doc_id", "line_no", "k", "number", F.array_join(F.transform(N.readings(F.col("number")), lambda v: v.cast("string")), ";").alias("readings"))


def number_readings(spark, d):
    """Prices written with points and a comma, and whole numbers with a point of thousands."""
    li = T(spark, d, "orders").select("o_orderkey", F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("price"), F.concat((F.col("o_custkey") % 9 + 1).cast("string"), F.lit("."), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")).alias("count"))
    said = li.select("o_orderkey", F.concat(F.lit("1. On 2020-01-02 F1L cost "), "price", F.lit(" (Smith, 2019), Fig. 7, "), "count", F.lit(" parts [R1]")).alias("t"))
    found = said.select("o_orderkey", F.posexplode(N.numbers(F.col("t"))).alias("k", "number"))
    return found.select("o_orderkey", "k", F.posexplode(N.readings(F.col("number"))).alias("j", "value"))


def _answers(spark, d):
    o = T(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.format_string("%.2f", F.col("o_totalprice").cast("double")).alias("price"), (F.col("o_orderkey") % 50).cast("string").alias("n"))
    text = F.concat(F.lit("The total (Smith, 2019) is "), "price", F.lit(" [R1].\n\n- repeated: "), "n", F.lit(" pieces\n- of others, 98,5% [Kab]\nLoose 77.5 stands here, and ["), F.when(F.col("k") % 7 == 0, "R9").otherwise("R1"), F.lit("] closes."))
    shown = F.concat(F.lit("Report of 2026-01-02: "), F.when(F.col("k") % 3 == 0, "none").otherwise(F.col("price")), F.lit(" and "), F.when(F.col("k") % 4 == 0, "none").otherwise(F.col("n")), F.when(F.col("k") % 5 == 0, " and 77,5").otherwise(""))
    return o.select("k", text.alias("text")), o.select("k", F.lit("R1").alias("mark"), shown.alias("text"))


def number_check(spark, d):
    """An answer for each order: a total, a list item that inherits the mark, a document's own number, and a loose one that a mark closes."""
    answers, blocks = _answers(spark, d)
    out = N.check_numbers(answers, blocks, "k")
    return out.select("k", *[F.array_join(c, ",").alias(c) for c in ("used", "invalid", "unverified")], "unmarked")


def citation_verdict(spark, d):
    """Grouped marks and a range, expanded; allowed are R0 to R20."""
    i = F.col("item_id")
    b = T(spark, d, "benchmark").select("item_id", F.when(i % 4 == 0, "none").otherwise(F.concat(F.lit("see [R"), i, F.lit(", R"), i + 1, F.lit("] e [R"), i, F.lit("-R"), i + 3, F.lit("]"))).alias("answer"))
    allowed = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.concat(F.lit("R"), k.cast("string")))
    used = b.select("item_id", N.marks(F.col("answer")).alias("u"))
    return used.select("item_id", F.array_join("u", ",").alias("marks"), N.citation_verdict(F.col("u"), allowed, i % 8 == 0).alias("verdict"))


def page_marks(spark, d):
    """Page marks and ranges, of ids that are given in full or abbreviated."""
    i = F.col("item_id")
    b = T(spark, d, "benchmark").select("item_id", F.concat(F.lit("see [Kdoc"), i % 5, F.lit("xp"), i % 9, F.lit("] and [Kdoc"), (i + 1) % 5, F.lit("p3-"), i % 7 + 1, F.lit("]")).alias("t"))
    ids = F.array(*[F.lit(f"Kdoc{k}x") for k in range(5)])
    return b.select("item_id", F.array_join(N.page_marks(F.col("t"), ids), ",").alias("pages"))


def question_units(spark, d):
    """Units of a comparison, one taken away, one equivalent, and the sources asked for."""
    n = F.lower("n_name")
    q = T(spark, d, "nation").select("n_nationkey", F.concat(F.lit("Compare "), n, F.lit(", item "), F.lpad((F.col("n_nationkey") % 3).cast("string"), 2, "0"), F.lit(" e "), n, F.lit(" usando duas fontes")).alias("q"))
    return P.plan_units(q, "n_nationkey", "q").select("n_nationkey", "sources", "unit", "name")


def recalled_units(spark, d):
    """T23: "for each" recalls the prior question's list; a model's unit stands for the equivalent part; what the question drops doesn't come back."""
    k = F.col("n_nationkey")
    q = T(spark, d, "nation").select("n_nationkey", F.when(k % 2 == 0, "Agora uma fonte para cada um").otherwise("Agora para ambos, retire gamma").alias("q"), F.concat(F.lit("Compare alpha"), F.lit(", gamma e MCC")).alias("p"), F.when(k % 3 == 0, F.array(F.struct(F.lit("Manutenção Centrada na Confiabilidade").alias("name"), F.lit("RCM").alias("query"), F.array(F.lit("MCC")).alias("aliases")))).alias("m"))
    return P.plan_units(q, "n_nationkey", "q", "p", "m").select("n_nationkey", "sources", "unit", "name", "query")


def coverage_check(spark, d):
    """Sections own their citations; the longest name in a heading decides."""
    k = F.col("n_nationkey")
    answers = T(spark, d, "nation").select("n_nationkey", F.concat(F.lit("### Reliability\nNothing [K"), k % 3, F.lit("].\n\n### Centred Reliability\nIt says [K"), k % 4, F.lit("].")).alias("text"))
    unit = lambda n, name: T(spark, d, "nation").select("n_nationkey", F.lit(n).alias("unit"), F.lit(name).alias("name"), (k % 5).cast("int").alias("n_found"))
    sent = T(spark, d, "nation").select("n_nationkey", F.lit(1).alias("unit"), F.lit("K1").alias("citation")).union(T(spark, d, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.lit(2), F.lit("K2")))
    out = P.check_coverage(answers, unit(1, "Reliability").union(unit(2, "Centred Reliability")), sent, "n_nationkey")
    return out.select("n_nationkey", "unit", "n_sent", F.array_join("cited", ",").alias("cited"), "status")


#: Messages with their intent alone, after an answer from the library, and after one from the results. "+" marks a subject near the library's.
MESSAGES = [
    ("você não respondeu", "conversation", "complaint", "results"), ("a resposta ficou incompleta", "conversation", "complaint", "results"), ("Aprofunde um pouco mais", "deeper", "deeper", "deeper"),
    ("quero mais detalhes sobre a calibração", "deeper", "deeper", "deeper"), ("Olá, bom dia!", "conversation", "conversation", "conversation"), ("Valeu! E a segunda fonte?", "conversation", "follow_up", "conversation"),
    ("anote que prefiro gráficos", "conversation", "conversation", "conversation"), ("Quais artigos há sobre inversores?", "collection", "collection", "collection"), ("Mostre a FIGURA 3 do artigo", "visual", "visual", "visual"),
    ("nossos resultados mostram o quê?", "results", "results", "results"), ("quantos alarmes falsos teve o modelo denso?", "results", "results", "results"), ("o capítulo é denso", "conversation", "follow_up", "results"),
    ("corrija este script em Python", "task", "task", "task"), ("traduza este parágrafo para um leigo", "task", "follow_up", "results"), ("qual critério define a calibração do limiar e a separação dos blocos de teste", "method", "method", "method"),
    ("o que a literatura diz sobre o envelhecimento de capacitores em inversores solares", "synthesis", "synthesis", "synthesis"), ("+capacitores eletrolíticos em inversores fotovoltaicos ligados à rede de baixa tensão", "query", "query", "query"),
    ("+explique por que os capacitores eletrolíticos envelhecem depressa em inversores ligados à rede", "synthesis", "synthesis", "synthesis"), ("ok, entendi", "conversation", "conversation", "results"), ("e na primavera?", "conversation", "follow_up", "results"),
]


def intent_routing(spark, d):
    """A message for every turn, in one of three contexts; every eleventh names a document, every thirteenth is like an example of a task."""
    k, said = F.col("turn") * 7 + F.col("conv_id"), F.array(*[F.lit(m[0]) for m in MESSAGES])
    c = T(spark, d, "conversations").select("conv_id", "turn", k.alias("k"), F.element_at(said, (k % len(MESSAGES) + 1).cast("int")).alias("q")).withColumn("near", F.when(F.col("q").startswith("+"), 0.5).otherwise(0.1))
    c = c.withColumn("q", F.regexp_replace("q", r"^\+", ""))
    k = F.col("k")
    return R.route(c, "q", k % 11 == 0, F.lit("task"), F.when(k % 13 == 0, 0.9).otherwise(0.1), F.lit(0.1), F.col("near"), k % 3 == 1, k % 3 == 2).select("conv_id", "turn", "intent")


def rewrite_kinds(spark, d):
    """Over messages of one planted kind each."""
    n = T(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("Compare FMEA e FMECA", "E o segundo?", "What is MCC of inverters", "inverter capacitor ageing temperature", "inverter"))), (F.col("c_custkey") % 5 + 1).cast("int")).alias("q"), F.when(F.col("c_custkey") % 2 == 0, "before").alias("p"))
    return n.select("c_custkey", R.rewrite_kind(F.col("q"), F.col("p"), F.col("c_custkey") % 15 == 3).alias("kind"))


def review_gate(spark, d):
    """Over messages of one planted kind each."""
    n = T(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("Oi, bom dia!", "Qual é a taxa?", "Prefiro respostas curtas", "O prazo ficou para maio.", "sim"))), (F.col("c_custkey") % 5 + 1).cast("int")).alias("q"), F.when(F.col("c_custkey") % 2 == 0, "Podemos usar esta?").otherwise("Feito.").alias("r"))
    return n.select("c_custkey", R.needs_review(F.col("q"), F.col("r"), F.col("c_custkey") % 35 == 1).alias("review"))


def written_requests(spark, d):
    """Requests at a clause's start or end are taken out and noted."""
    q = F.element_at(F.array(*map(F.lit, ("Use o modelo maior. O que é MCC?", "Explique MCC, só com trechos?", "Sem a biblioteca de componentes, o que é MCC?", "Busque na web e explique MCC", "Use a skill alfa. Leia o artigo inteiro do Silva"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    w = T(spark, d, "customer").select("c_custkey", R.directives(q, ("alfa",)).alias("w"))
    return w.select("c_custkey", F.col("w.text").alias("text"), F.array_join(F.array_sort(F.transform(F.map_entries("w.choices"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("choices"))


def requested_blocks(spark, d):
    """Blocks on request go only where the question holds one of their terms."""
    b = T(spark, d, "part").select("p_partkey", F.lower("p_name").alias("question"), F.when(F.col("p_partkey") % 3 != 0, F.array(F.lit("1"), F.concat(F.lit("PART "), (F.col("p_partkey") % 10).cast("string")))).alias("terms"))
    return R.requested_blocks(b, "question", "terms").select("p_partkey")


def caption_labels(spark, d):
    """Captions planted before every document."""
    k = F.col("doc_id")
    t = F.concat(F.lit("Figure "), k % 9, F.lit(". Words\nnot a Table 3 here\n  Tabela "), k % 4, F.lit("-1 more\nFIG. "), k % 9, F.lit(" again\n"), F.coalesce("text", F.lit("")))
    return T(spark, d, "documents").select("doc_id", F.explode(G.captions(t)).alias("label"))


def _planted_pages(spark, d):
    """Pages of documents (twenty each) with strokes, boxes, a way of reading and a confidence."""
    k = F.col("doc_id")
    box = lambda a, b: F.struct(F.lit(a).alias("left"), F.lit(0.0).alias("bottom"), F.lit(b).alias("right"), F.lit(b).alias("top"))
    return T(spark, d, "documents").select(
        F.floor(k / 20).alias("book"), k.alias("page"), F.when(k % 10 == 0, F.concat(F.lit("Tab. "), k % 7, F.lit(" rows"))).otherwise("plain words").alias("text"), F.when(k % 6 == 0, "ocr").otherwise("native").alias("method"),
        (k % 100).cast("double").alias("confidence"), F.when(k % 8 == 0, 400).otherwise(k % 5 * 10).alias("strokes"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"),
        F.when(k % 9 == 0, F.array(box(-5.0, 100.0))).when(k % 9 == 1, F.array(box(0.0, 25.0), box(0.0, 25.0), box(0.0, 10.0))).otherwise(F.array(box(0.0, 10.0))).alias("boxes"),
    )


def page_signals(spark, d):
    out = G.page_signals(_planted_pages(spark, d), "book", "page")
    return out.select("page", "n_images", "drawing", F.array_join("labels", ",").alias("labels"), "scanned", "unclear")


def figure_text(spark, d):
    """A page's lines against planted recognised ones: a piece of the page, a short word of it, new words and a repeat."""
    docs = T(spark, d, "documents").where("text is not null").select("doc_id", "text")
    page = docs.select("doc_id", F.concat(F.lit("the quick brown fox jumps "), F.substring("text", 1, 80)).alias("text"))
    said = F.array(F.lit("Quick-Brown fox JUMPS high"), F.lit("quick"), F.lit("zzqx axis label"), F.lit("zzqx axis label"), F.when(F.col("doc_id") % 2 == 0, "vvkw").otherwise("q"))
    lines = docs.select("doc_id", F.posexplode(said).alias("line_no", "line")).withColumn("confidence", 50.0 + F.col("line_no"))
    return G.new_figure_text(lines, page, ["doc_id"])


def figure_items(spark, d):
    """Described items with a label and a caption that the page bears out or not."""
    k = F.col("doc_id")
    page = T(spark, d, "documents").select("doc_id", F.concat(F.lit("Figure "), k % 5, F.lit(". Pressure over time\nvalues 12,5 and pressure\n")).alias("text"), F.lit("local axis 99").alias("local_text"))
    item = lambda n: T(spark, d, "documents").select("doc_id", F.lit(n).alias("item_no"), F.when(k % 4 == 0, "table").otherwise("figure").alias("kind"), F.concat(F.lit("Figure "), F.when(k % 3 == 0, k % 5 + 1).otherwise(k % 5), F.lit(":")).alias("label"), F.when(k % 2 == 0, "Pressure over TIME").otherwise("Something else entirely").alias("caption"), F.when(k % 11 == 10, "  ").otherwise("It shows 12.5 and 77").alias("description"), F.array(F.lit("pressure axis"), F.lit("unseen")).alias("visible"), F.lit("99 | 1").alias("cells"))
    out = G.check_items(item(1).union(item(2)), page, ["doc_id"])
    return out.select("doc_id", "item_no", "label", F.length("caption").alias("caption"), "checked", F.array_join("unchecked", ";").alias("unchecked"))


def open_issues(spark, d):
    """Issues of described and of blank pages are settled."""
    li = T(spark, d, "lineitem")
    issue = F.concat(F.lit("Page "), "l_linenumber", F.when(F.col("l_suppkey") % 3 == 0, ": low confidence").when(F.col("l_suppkey") % 3 == 1, ": without usable text").otherwise(" is odd"))
    issues = li.select(F.col("l_orderkey").alias("doc"), issue.alias("issue"))
    described = li.where("l_quantity > 40").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("page"))
    blank = li.where("l_quantity < 10").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("page"))
    return G.open_issues(issues, described, blank, "doc", "issue")


#: What goes before a named document, and before an example: rules that come earlier in T17's order.
_INTENTS = "[" + ", ".join(f"['{a}', '{b}', '{c}']" for _, a, b, c in MESSAGES) + "]"
QUERIES = {
    "number_extract": (number_extract, None),
    "number_readings": (number_readings, "WITH o AS (SELECT o_orderkey, round(o_totalprice::DOUBLE, 2) AS p, (o_custkey % 9 + 1) AS a, o_orderkey % 1000 AS b FROM orders) SELECT o_orderkey, 0 AS k, 0 AS j, p AS value FROM o UNION ALL SELECT o_orderkey, 1, 0, round(a + b / 1000.0::DOUBLE, 3) FROM o UNION ALL SELECT o_orderkey, 1, 1, (a * 1000 + b)::DOUBLE FROM o"),
    "number_check": (number_check, "WITH o AS (SELECT o_orderkey k, o_orderkey % 50 n, o_totalprice::DOUBLE p, printf('%.2f', o_totalprice::DOUBLE) s FROM orders), v AS (SELECT *, [2026.0::DOUBLE] || CASE WHEN k % 3 = 0 THEN [] ELSE [p] END || CASE WHEN k % 4 = 0 THEN [] ELSE [n::DOUBLE] END || CASE WHEN k % 5 = 0 THEN [77.5::DOUBLE] ELSE [] END AS vals FROM o), c AS (SELECT k, list_filter([CASE WHEN NOT list_contains(vals, p) THEN s END, CASE WHEN NOT list_contains(vals, n::DOUBLE) THEN n::VARCHAR END, CASE WHEN k % 7 <> 0 AND NOT list_contains(vals, 77.5::DOUBLE) THEN '77.5' END], lambda x: x IS NOT NULL) AS bad, (k % 7 = 0 AND NOT list_contains(vals, 77.5::DOUBLE))::INT AS loose FROM v) SELECT k, CASE WHEN k % 7 = 0 THEN 'R1,R9' ELSE 'R1' END AS used, CASE WHEN k % 7 = 0 THEN 'R9' ELSE '' END AS invalid, array_to_string(bad, ',') AS unverified, loose AS unmarked FROM c"),
    "citation_verdict": (citation_verdict, "WITH m AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN [] ELSE list_transform(range(item_id, item_id + 4), lambda i: 'R' || i) END AS u FROM benchmark) SELECT item_id, array_to_string(u, ',') AS marks, CASE WHEN len(u) = 0 THEN CASE WHEN item_id % 8 = 0 THEN 'web_grounded' ELSE 'uncited' END WHEN len(list_filter(u, lambda x: NOT list_contains(list_transform(range(0, 21), lambda j: 'R' || j), x))) = 0 THEN 'verified' ELSE 'invalid' END AS verdict FROM m"),
    "page_marks": (page_marks, "SELECT item_id, array_to_string(list_distinct_ordered, ',') AS pages FROM (SELECT item_id, CASE WHEN (item_id % 5 = (item_id + 1) % 5) THEN [] ELSE ['Kdoc' || (item_id % 5) || 'xp' || (item_id % 9)] END || list_transform(CASE WHEN item_id % 7 + 1 >= 3 THEN range(3, item_id % 7 + 2) ELSE [] END, lambda p: 'Kdoc' || ((item_id + 1) % 5) || 'xp' || p) AS list_distinct_ordered FROM benchmark)"),
    "question_units": (question_units, "WITH u AS (SELECT n_nationkey, unnest([lower(n_name), 'item 0' || (n_nationkey % 3), lower(n_name) || ' usando duas fontes']) AS name, unnest([1, 2, 3]) AS unit FROM nation) SELECT n_nationkey, 2 AS sources, unit, name FROM u"),
    "recalled_units": (recalled_units, "WITH q AS (SELECT n_nationkey k, CASE WHEN n_nationkey % 3 = 0 THEN [('Manutenção Centrada na Confiabilidade', 'RCM')] ELSE [] END || [('alpha', 'alpha')] || CASE WHEN n_nationkey % 2 = 0 THEN [('gamma', 'gamma')] ELSE [] END || CASE WHEN n_nationkey % 3 <> 0 THEN [('MCC', 'MCC')] ELSE [] END AS u FROM nation) SELECT k AS n_nationkey, CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END AS sources, i::INT AS unit, u[i][1] AS name, u[i][2] AS query FROM (SELECT k, u, unnest(range(1, len(u) + 1)) i FROM q)"),
    "coverage_check": (coverage_check, "WITH u AS (SELECT n_nationkey k, 1 AS unit, 1 AS n_sent, n_nationkey % 3 = 1 AS c, 'K1' AS m FROM nation UNION ALL SELECT n_nationkey, 2, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END, n_nationkey % 2 = 0 AND n_nationkey % 4 = 2, 'K2' FROM nation) SELECT k AS n_nationkey, unit, n_sent, CASE WHEN c THEN m ELSE '' END AS cited, CASE WHEN c THEN 'cited' WHEN n_sent > 0 THEN 'uncited' WHEN k % 5 > 0 THEN 'not sent' ELSE 'no candidate' END AS status FROM u"),
    "intent_routing": (intent_routing, f"""WITH c AS (SELECT conv_id, turn, turn * 7 + conv_id AS k, {_INTENTS}[(turn * 7 + conv_id) % {len(MESSAGES)} + 1][(turn * 7 + conv_id) % 3 + 1] AS said, (turn * 7 + conv_id) % {len(MESSAGES)} AS i FROM conversations)
SELECT conv_id, turn, CASE WHEN said IN ('complaint', 'deeper') THEN said WHEN k % 11 = 0 THEN 'document' WHEN k % 13 = 0 AND (said IN ('method', 'query') OR (i = 17) OR (said = 'conversation' AND k % 3 = 0 AND i IN (0, 1, 11, 18, 19))) THEN 'task' ELSE said END AS intent FROM c"""),
    "rewrite_kinds": (rewrite_kinds, "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'plan' WHEN c_custkey % 5 IN (1, 2, 4) OR c_custkey % 15 = 3 THEN 'simple' ELSE 'none' END AS kind FROM customer"),
    "review_gate": (review_gate, "SELECT c_custkey, CASE WHEN c_custkey % 35 = 1 THEN true WHEN c_custkey % 5 IN (0, 1) THEN false WHEN c_custkey % 5 IN (2, 3) THEN true ELSE c_custkey % 2 = 0 END AS review FROM customer"),
    "written_requests": (written_requests, "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'O que é MCC?' WHEN 1 THEN 'Explique MCC?' WHEN 2 THEN 'Sem a biblioteca de componentes, o que é MCC?' WHEN 3 THEN 'Explique MCC' ELSE 'Leia o artigo inteiro do Silva' END AS text, CASE c_custkey % 5 WHEN 0 THEN 'model=strong' WHEN 1 THEN 'reading=passages' WHEN 2 THEN '' WHEN 3 THEN 'web=yes' ELSE 'reading=document,skill=alfa' END AS choices FROM customer"),
    "requested_blocks": (requested_blocks, "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 OR contains(lower(p_name), '1') OR contains(lower(p_name), 'part ' || (p_partkey % 10))"),
    "caption_labels": (caption_labels, r"SELECT doc_id, unnest(list_distinct(['fig ' || (doc_id % 9), 'tab ' || (doc_id % 4) || '-1'])) AS label FROM documents"),
    "page_signals": (page_signals, "WITH p AS (SELECT doc_id // 20 AS book, doc_id k, doc_id % 6 = 0 AS ocr, CASE WHEN doc_id % 8 = 0 THEN 400 ELSE doc_id % 5 * 10 END AS strokes FROM documents), m AS (SELECT *, median(strokes) OVER (PARTITION BY book) md FROM p), s AS (SELECT k AS page, CASE WHEN ocr OR k % 9 = 0 THEN 0 WHEN k % 9 = 1 THEN 1 ELSE 0 END AS n_images, strokes >= 150 AND strokes - md >= 150 AS drawing, CASE WHEN k % 10 = 0 THEN 'tab ' || (k % 7) ELSE '' END AS labels, ocr OR k % 9 = 0 AS scanned, (ocr OR k % 9 = 0) AND k % 100 < 60 AS unclear FROM m) SELECT * FROM s WHERE n_images > 0 OR drawing OR labels <> '' OR unclear"),
    "figure_text": (figure_text, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'zzqx axis label' || chr(10) || 'vvkw' ELSE 'zzqx axis label' END AS text, CASE WHEN doc_id % 2 = 0 THEN 53.0 ELSE 52.0 END AS confidence FROM documents WHERE text IS NOT NULL"),
    "figure_items": (figure_items, "WITH i AS (SELECT doc_id k, unnest([1, 2]) AS n FROM documents WHERE doc_id % 11 <> 10) SELECT k AS doc_id, n AS item_no, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 4 = 0 THEN 'table' ELSE 'figure' END || ' without a label ' || n ELSE 'Figure ' || (k % 5) || CASE WHEN n = 2 THEN ' (2)' ELSE '' END END AS label, CASE WHEN k % 2 = 0 THEN 18 ELSE 0 END AS caption, CASE WHEN k % 5 = 1 THEN 71 ELSE 57 END AS checked, CASE WHEN k % 5 = 1 THEN '77' ELSE '1;77' END AS unchecked FROM i"),
    "open_issues": (open_issues, "WITH l AS (SELECT *, l_linenumber::BIGINT p FROM lineitem) SELECT l_orderkey AS doc, 'Page ' || l_linenumber || CASE l_suppkey % 3 WHEN 0 THEN ': low confidence' WHEN 1 THEN ': without usable text' ELSE ' is odd' END AS issue FROM l WHERE l_suppkey % 3 = 2 OR NOT (EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = l.l_orderkey AND b.l_linenumber = l.l_linenumber AND b.l_quantity > 40) OR (l_suppkey % 3 = 1 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = l.l_orderkey AND b.l_linenumber = l.l_linenumber AND b.l_quantity < 10)))"),
}
