"""Library and memory operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.retrieval import folded, words
from .selection import quantiles


def reuse_vectors(new: DataFrame, old: DataFrame, text: str, vector: str) -> DataFrame:
    """Chunks with the vector of an old chunk of the same text; the others (null) are all that the encoder must see."""
    known = old.groupBy(text).agg(F.first(vector, ignorenulls=True).alias(vector))
    return new.join(known, text, "left")


def opening_text(sections: DataFrame, doc: str, order: str, text: str, chars: int) -> DataFrame:
    """The first characters of a document's sections in order. Sections beyond the limit aren't gathered."""
    before = F.coalesce(F.sum(F.length(text) + 1).over(Window.partitionBy(doc).orderBy(order, text).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = sections.withColumn("_b", before).where(F.col("_b") <= chars)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return few.groupBy(doc).agg(F.substring(joined, 1, chars).alias("opening"))


def without_support(chunks: DataFrame, locator: str, question_words: Column, support_words: tuple[str, ...], suffixes: tuple[str, ...]) -> DataFrame:
    """Chunks of contents or reference lists are left out, unless the question speaks of such."""
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col(locator).endswith(s)
    return chunks.where(~ends | F.arrays_overlap(question_words, F.array(*map(F.lit, support_words))))


def visible_notes(notes: DataFrame, skill: str, always: tuple[str, ...]) -> DataFrame:
    """Active notes that always show, or of no skill or this one."""
    return notes.where((F.col("status") == "active") & (F.col("kind").isin(*always) | F.col("skill").isNull() | (F.col("skill") == skill)))


def from_elsewhere(rows: DataFrame, conversation: str, current: str | None) -> DataFrame:
    """Rows not forgotten and not of this conversation; a null conversation is a value of its own."""
    return rows.where((F.col("forgotten") == 0) & ~F.col(conversation).eqNullSafe(F.lit(current)))


def _squash(text: Column) -> Column:
    return F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", "")


def title_named(question: Column, title: Column, least: int = 12) -> Column:
    """Whether the title, if long enough, stands in the question; case, accents, marks and blanks don't count."""
    return (F.length(_squash(title)) >= least) & _squash(question).contains(_squash(title))


def titles_in(questions: DataFrame, name: str, question: str, cards: DataFrame, title: str, least: int = 12) -> DataFrame:
    """J18 for many questions and titles: (name, all columns of cards) where `title_named` holds. Joined on the title's first `least` characters, which the question must hold somewhere, so no pair is tried in vain."""
    asked = questions.select(name, _squash(F.col(question)).alias("_q"))
    starts = F.sequence(F.lit(1), F.length("_q") - (least - 1))
    pieces = asked.where(F.length("_q") >= least).select(name, "_q", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("_q"), i, F.lit(least))))).alias("_p"))
    held = cards.withColumn("_t", _squash(F.col(title))).where(F.length("_t") >= least).withColumn("_p", F.substring("_t", 1, least))
    return held.join(pieces, "_p").where(F.col("_q").contains(F.col("_t"))).drop("_p", "_q", "_t")


def named_documents(question: Column, title: Column, surnames: Column, doi: Column, stop_words: tuple[str, ...], least: int = 12) -> Column:
    """Whether the question names a card by an author's surname (three letters or more, no stop word), by its title or by its DOI. Case and accents don't count."""
    known = F.filter(F.transform(F.coalesce(surnames, F.array().cast("array<string>")), folded), lambda x: (F.length(x) >= 3) & ~x.isin(*stop_words))
    by_doi = (F.length(F.coalesce(doi, F.lit(""))) > 0) & folded(question).contains(folded(doi))
    return F.arrays_overlap(known, words(question)) | F.coalesce(title_named(question, title, least), F.lit(False)) | F.coalesce(by_doi, F.lit(False))


def only_named(chunks: DataFrame, question: Column, named: Column) -> DataFrame:
    """Where the question says only/apenas, chunks of the documents that it names; else all."""
    return chunks.where(~question.rlike(r"(?i)\b(only|apenas|somente|s[oó])\b") | named)


def caption_descriptions(mentions: DataFrame, descriptions: DataFrame, on: list[str], position: str, item: str) -> DataFrame:
    """Each mention with the earliest description of the same place and label. Of equal positions (a column or a struct) the caller's order decides: `position` should be total."""
    first = descriptions.groupBy(*on).agg(F.min_by(item, position).alias("description"))
    return mentions.join(first, on, "left")


def figure_summary(figures: DataFrame, key: str) -> DataFrame:
    """Pages, those with text, those described, items, and the latest model of each file."""
    return figures.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("local_text") != "").alias("with_text"), F.count("model").alias("described"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("items"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("read_at"))).alias("last_model"))


def trail_weights(visits: DataFrame, per: list[str], page: str, similarity: str, order: str, top: int = 12) -> DataFrame:
    """Weight of each page: summed similarities, the latest exchange counting double; ties in order of first citation."""
    latest = F.max(order).over(Window.partitionBy(*per))
    w = visits.withColumn("_l", latest).groupBy(*per, page).agg(F.sum(F.col(similarity) * F.when(F.col(order) == F.col("_l"), 2).otherwise(1)).alias("weight"), F.min(order).alias("first_seen"))
    w = w.withColumn("weight", F.round("weight", 9))
    return w.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("weight"), "first_seen", page))).where(F.col("place") <= top)


def best_lesson(lessons: DataFrame, field: str, similarity: str, created: str, value: str, least: float) -> DataFrame:
    """Per field the value of the most similar lesson, the latest of equals."""
    return lessons.where(F.col(similarity) >= least).groupBy(field).agg(F.max_by(value, F.struct(similarity, created)).alias(value), F.max(similarity).alias(similarity))


def grouped_notes(notes: DataFrame, documents: DataFrame) -> DataFrame:
    """Notes by resolved source: their document, else the note they correct, else their conversation, else other."""
    d = documents.select(F.col("doc").alias("_doc")).distinct()
    n = notes.join(d, F.col("source_doc") == F.col("_doc"), "left")
    group = F.coalesce(F.concat(F.lit("doc:"), "_doc"), F.concat(F.lit("note:"), "corrects"), F.concat(F.lit("conv:"), "conversation"), F.lit("other"))
    return n.groupBy(group.alias("source")).agg(F.count(F.lit(1)).alias("n_notes"), F.min("note").alias("first_note"))


def first_texts(rows: DataFrame, name: str, order: str, text: str) -> DataFrame:
    """The first text of each name."""
    return rows.groupBy(name).agg(F.min_by(text, order).alias(text))


def decorrelation(acf: DataFrame, block: str, lags: int, limit: float, share: float, purge: int) -> DataFrame:
    """Of each block the first lag at which enough variables fall below the limit (null if none), and over all blocks the lag needed and whether the purge covers it. acf: block, variable, acf1 .. acf[lags]."""
    low = acf.groupBy(block).agg(*[F.avg((F.abs(F.col(f"acf{k}")) < limit).cast("double")).alias(f"_s{k}") for k in range(1, lags + 1)])
    lag = F.coalesce(*[F.when(F.col(f"_s{k}") >= share, F.lit(k)) for k in range(1, lags + 1)])
    each = low.select(block, lag.alias("lag"))
    whole = each.agg(F.max("lag").alias("_m"), F.count_if(F.col("lag").isNull()).alias("_none"))
    needed = F.when(F.col("_none") == 0, F.col("_m"))
    return each.crossJoin(F.broadcast(whole)).select(block, "lag", needed.alias("needed"), F.coalesce(needed <= purge + 1, F.lit(False)).alias("sufficient"))


def shift_in_ranges(rows: DataFrame, per: list[str], value: str, baseline: str) -> DataFrame:
    """Medians before and after, and the change in interquartile ranges of the baseline; groups may be of any size."""
    parts = rows.where(F.col(baseline).isNotNull()).select(*per, F.col(baseline).alias("_base"), value)
    q = quantiles(parts, [*per, "_base"], value, (0.25, 0.5, 0.75))
    pick = lambda cond, i: F.max(F.when(cond, F.col("q")[i]))  # noqa: E731  one row of each group
    m = q.groupBy(*per).agg(pick(F.col("_base"), 1).alias("before"), pick(~F.col("_base"), 1).alias("after"), pick(F.col("_base"), 0).alias("_q1"), pick(F.col("_base"), 2).alias("_q3"))
    return m.withColumn("change", F.try_divide(F.col("after") - F.col("before"), F.col("_q3") - F.col("_q1"))).drop("_q1", "_q3")


def strongest(rows: DataFrame, per: list[str], value: str, tie: str, k: int = 2) -> DataFrame:
    """The k largest by absolute value of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc_nulls_last(F.abs(F.col(value))), tie))).where(F.col("place") <= k)


def stability(runs: DataFrame, per: list[str], value: str) -> DataFrame:
    """Least, median and greatest over seeds."""
    return runs.groupBy(*per).agg(F.min(value).alias("least"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("most"))


def plan_coverage(sent: DataFrame, candidates: DataFrame, on: list[str], unit: str) -> DataFrame:
    """Of each unit of a plan the candidate places, those sent, and whether it is covered, partial or missing."""
    got = candidates.join(sent.select(*on).distinct().withColumn("_s", F.lit(1)), on, "left")
    n = got.groupBy(unit).agg(F.count(F.lit(1)).alias("n_places"), F.count("_s").alias("n_sent"))
    return n.withColumn("status", F.when(F.col("n_sent") == 0, "missing").when(F.col("n_sent") < F.col("n_places"), "partial").otherwise("covered"))


def accepted_notes(notes: DataFrame, sources: DataFrame, kinds: tuple[str, ...], per: str, most: int) -> DataFrame:
    """Notes of a known kind, facts only with a citation among the sources, at most `most` of each reply in order."""
    ok = notes.join(sources.select(F.col("citation").alias("_c")).distinct(), F.col("citation") == F.col("_c"), "left").where(F.col("kind").isin(*kinds) & ((F.col("kind") != "fact") | F.col("_c").isNotNull()))
    return ok.withColumn("place", F.row_number().over(Window.partitionBy(per).orderBy("note"))).where(F.col("place") <= most).drop("_c")


def indicators(wide: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Wide results as (key, indicator, value)."""
    return wide.unpivot(key, names, "indicator", "value")


def matching(rows: DataFrame, **conditions) -> DataFrame:
    """Rows of the given values; a condition of None isn't applied, a list means any of its values."""
    for name, value in conditions.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return rows


def current_pages(trail: DataFrame, documents: DataFrame, digest: str) -> DataFrame:
    """Pages of a trail with the current document of the same content; those that have vanished drop."""
    now = documents.groupBy(digest).agg(F.min("doc").alias("doc"))
    return trail.join(now, digest)


def clear_onsets(panels: DataFrame, onsets: DataFrame, trial: str) -> DataFrame:
    """Each panel with the trial's observed onset where that is clear, else null."""
    o = onsets.select(trial, F.when(F.col("stability") == "clear", F.col("observed")).alias("onset"))
    return panels.join(o, trial, "left")


def grouped_hits(hits: DataFrame, query: str, title: str, rank: str) -> DataFrame:
    """A query's hits by title, titles in the order of their best hit, with counts, and each title's hits in order."""
    own = hits.groupBy(query, title).agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("n_hits"), F.transform(F.array_sort(F.collect_list(F.struct(rank))), lambda x: x[rank]).alias("ranks"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("_first"))).drop("_first")
