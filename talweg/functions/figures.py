"""Figures of documents: captions, page signals, checks of described items, text recognised in figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import folded

# Words that open a caption, the least share of a page that a figure takes, what counts as the whole page,
# strokes of a drawing, confidence of weak recognition, and letters of a piece of text.
CAPTION = r"(?im)^[ \t]*(?:fig(?:ure|ura)?s?\.?|tab(?:le|ela)?s?\.?|quadro|gr[áa]fico)[ \t]*\d+(?:[.\-]\d+)*"
AREA, WIDE, HIGH, STROKES, CONFIDENCE, PIECE, STEP = 0.04, 0.98, 0.90, 150, 60.0, 12, 4


def squashed(text: Column) -> Column:
    return F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", "")


def captions(text: Column) -> Column:
    """Distinct labels that open a line, as the first three letters and the number ("fig 2"), in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({CAPTION})"), F.lit(1))
    label = lambda x: F.concat(F.substring(F.ltrim(folded(x)), 1, 3), F.lit(" "), F.regexp_extract(x, r"(\d+(?:[.\-]\d+)*)$", 1))
    return F.array_distinct(F.transform(found, label))


def page_signals(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Pages with something to see: an embedded image, a drawing of far more strokes than the document's median page, a caption, or text that was recognised badly.

    pages: doc, page, text, method, confidence, strokes, width, height, boxes (structs of left, bottom, right, top).
    """
    usual = pages.groupBy(doc).agg(F.percentile("strokes", 0.5).alias("_median"))  # a document's pages
    inside = F.transform("boxes", lambda b: F.struct(F.greatest(b["left"], F.lit(0.0)).alias("l"), F.greatest(b["bottom"], F.lit(0.0)).alias("b"), F.least(b["right"], F.col("width")).alias("r"), F.least(b["top"], F.col("height")).alias("t")))
    w, h = F.col("width"), F.col("height")
    full = F.exists("_in", lambda b: (b["r"] - b["l"] >= WIDE * w) & (b["t"] - b["b"] >= HIGH * h))
    some = F.filter("_in", lambda b: (b["r"] > b["l"]) & (b["t"] > b["b"]) & ((b["r"] - b["l"]) * (b["t"] - b["b"]) >= AREA * w * h) & ~((b["r"] - b["l"] >= WIDE * w) & (b["t"] - b["b"] >= HIGH * h)))
    seen = pages.withColumn("_in", inside).join(usual, doc).withColumn("scanned", full | (F.col("method") == "ocr"))
    seen = seen.withColumn("n_images", F.when(F.col("scanned"), 0).otherwise(F.size(F.array_distinct(some))))
    seen = seen.withColumn("drawing", (F.col("strokes") >= STROKES) & (F.col("strokes") - F.col("_median") >= STROKES)).withColumn("labels", captions(F.col("text")))
    seen = seen.withColumn("unclear", F.coalesce(F.col("scanned") & (F.col("confidence") < CONFIDENCE), F.lit(False)))
    return seen.where((F.col("n_images") > 0) | F.col("drawing") | (F.size("labels") > 0) | F.col("unclear")).select(doc, page, "n_images", "drawing", "labels", "scanned", "unclear")


def new_figure_text(lines: DataFrame, pages: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """Of the lines recognised inside a page's figures those that the page doesn't hold yet, joined, if they have `least` words.

    A line is on the page already if it stands there whole, or, if it is long, if a piece of PIECE letters does.
    lines: key, line_no, line, confidence; pages: key, text.
    """
    both = lines.join(pages.select(*key, squashed(F.col("text")).alias("_page")), key).withColumn("_s", squashed(F.col("line")))
    n = F.length("_s")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n - PIECE, F.lit(0)), F.lit(STEP)), lambda i: F.substr(F.col("_s"), i + 1, F.lit(PIECE)))
    known = F.when(n < PIECE, (n >= 4) & F.col("_page").contains(F.col("_s"))).otherwise(F.exists(pieces, lambda p: F.col("_page").contains(p)))
    new = both.where((n >= 2) & ~known).groupBy(*key, "line").agg(F.min(F.struct("line_no", "confidence")).alias("_f"))
    out = new.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_f.line_no"), F.col("line")))), lambda x: x["line"]), "\n").alias("text"), F.round(F.avg("_f.confidence"), 1).alias("confidence"))
    return out.where(F.regexp_count("text", F.lit(r"\p{L}{3,}")) >= least)


def check_items(items: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Described figures and tables with only what their page bears out.

    The label stays if the page has such a caption, the caption if it is written on the page. `checked` is the share (0 to
    100) of the claimed words and numbers that the page holds; numbers that it doesn't hold are listed. Equal labels of a page
    get (2), (3) ...; items without one are counted by kind.
    items: key, item_no, kind, label, caption, description, visible (array), cells; pages: key, text, local_text.
    """
    letters = lambda t: F.array_distinct(F.regexp_extract_all(folded(t), F.lit(r"(\p{L}{4,})"), F.lit(1)))
    figures = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"(\d+(?:[.,]\d+)*)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("."))))
    shown = F.concat_ws("\n", "text", "local_text")
    page = pages.select(*key, captions(F.col("text")).alias("_labels"), squashed(F.col("text")).alias("_page"), letters(shown).alias("_words"), figures(shown).alias("_numbers"))
    both = items.where(F.trim(F.coalesce("description", F.lit(""))) != "").join(page, key)
    claimed = F.concat_ws("\n", F.array_join("visible", " "), "cells")
    both = both.withColumn("_w", letters(claimed)).withColumn("_n", figures(F.concat_ws("\n", claimed, F.col("description"))))
    bare = F.regexp_replace(F.coalesce("label", F.lit("")), r"[\s.:—–-]+$", "")
    own = F.coalesce(F.get(captions(bare), F.lit(0)), F.lit(""))
    both = both.withColumn("label", F.when((own != "") & F.array_contains("_labels", own), bare).otherwise(""))
    told = squashed(F.col("caption"))
    both = both.withColumn("caption", F.when((F.length(told) >= 8) & F.col("_page").contains(F.substring(told, 1, 40)), F.col("caption")).otherwise(""))
    total = F.size("_w") + F.size("_n")
    hits = F.size(F.array_intersect("_w", "_words")) + F.size(F.array_intersect("_n", "_numbers"))
    k = F.row_number().over(Window.partitionBy(*key, F.when(F.col("label") == "", F.col("kind")).otherwise("label"), "label").orderBy("item_no"))
    name = F.when(F.col("label") == "", F.concat_ws(" ", "kind", F.lit("without a label"), k.cast("string"))).when(k == 1, F.col("label")).otherwise(F.concat("label", F.lit(" ("), k.cast("string"), F.lit(")")))
    return both.select(*key, "item_no", "kind", name.alias("label"), "caption", "description", F.when(total > 0, F.round(100 * hits / total)).cast("int").alias("checked"), F.slice(F.array_sort(F.array_except("_n", "_numbers")), 1, 20).alias("unchecked"))


def open_issues(issues: DataFrame, described: DataFrame, blank: DataFrame, doc: str, issue: str) -> DataFrame:
    """Issues without those that are settled: of a page that was described, or "without usable text" of a blank page.

    issues: doc, issue ("Page 3: ..."); described, blank: doc, page.
    """
    page = F.regexp_extract(issue, r"^Page (\d+): (low confidence|without usable text)", 1).try_cast("long")
    rows = issues.withColumn("_page", page).withColumn("_bare", F.col(issue).contains("without usable text"))
    settled = described.select(F.col(doc).alias("_d"), F.col("page").alias("_p"), F.lit(False).alias("_b")).union(blank.select(doc, "page", F.lit(True)))
    return rows.join(settled, (F.col(doc) == F.col("_d")) & (F.col("_page") == F.col("_p")) & (~F.col("_b") | F.col("_bare")), "left_anti").drop("_page", "_bare")
