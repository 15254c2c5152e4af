"""Catalog operators: versions, overlays, drift, pruning, chains, folds and comparisons (P01, J01-J15, A08, S10-S17, U-S5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .ranking import global_rank, prefix_sums


def latest_by(df: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The latest version of each key. An aggregation with map-side combine, so a hot key is no hot task."""
    best = F.max_by(F.struct(*order, *[c for c in keep if c not in order]), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_b")).select(*key, *[F.col("_b")[c].alias(c) for c in dict.fromkeys([*order, *keep])])


def overlay(base: DataFrame, inferred: DataFrame, edited: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Card overlay; an edit wins over the inference, a missing card is null."""
    a, b = inferred.select(key, *[F.col(f).alias(f"_i_{f}") for f in fields]), edited.select(key, *[F.col(f).alias(f"_e_{f}") for f in fields])
    return base.join(a, key, "left").join(b, key, "left").select(*base.columns, *[F.coalesce(f"_e_{f}", f"_i_{f}").alias(f) for f in fields])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` that share the key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def drift(stored: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """Stored rows that the index lacks or holds differently."""
    other = index.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    state = F.when(F.col("_k").isNull(), "missing").when(~F.col(text).eqNullSafe(F.col("_t")), "different")
    return stored.join(other, F.col(key) == F.col("_k"), "left").withColumn("issue", state).where("issue is not null").drop("_k", "_t")


def prune_report(rows: DataFrame, active: DataFrame, key: str, size: Column) -> DataFrame:
    """What would go with rows that are not active: how many, and how many bytes. Null keys never count as active."""
    return rows.join(active.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes"))


def prune(runs: DataFrame, chunks: DataFrame, active: DataFrame, run: str, size: Column, execute: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs and chunks as they stay, and a report of what goes (runs, chunks, bytes). Without `execute` everything stays."""
    keep = active.where(F.col(run).isNotNull()).select(run).distinct()
    gone_runs, gone = runs.join(keep, run, "left_anti"), chunks.join(keep, run, "left_anti")
    report = gone_runs.agg(F.count(F.lit(1)).alias("n_runs")).crossJoin(gone.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes")))
    return (runs.join(keep, run, "left_semi"), chunks.join(keep, run, "left_semi"), report) if execute else (runs, chunks, report)


def verify(originals: DataFrame, artifacts: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """One table of issues (place, issue): originals and artifacts whose content isn't what was recorded, chunks that a run recorded and lacks or holds without a record, and index entries that drift.

    originals, artifacts: place, recorded, found (digests, found null if missing); chunks: run, id, text; index: id, text; a
    recorded set of chunk ids comes as rows of artifacts' column `chunk_ids` (array), null where none was recorded.
    """
    digest = lambda t, what: t.select("place", F.when(F.col("found").isNull(), f"{what} missing").when(F.col("found") != F.col("recorded"), f"{what} changed").alias("issue")).where("issue is not null")
    listed = artifacts.where("chunk_ids is not null").select(F.col("place").alias("run"), F.explode("chunk_ids").alias("id"))
    held = chunks.join(artifacts.where("chunk_ids is not null").select(F.col("place").alias("run")), "run", "left_semi").select("run", "id")
    lacks = listed.exceptAll(held).select(F.col("run").alias("place"), F.concat(F.lit("chunk lacks: "), "id").alias("issue"))
    more = held.exceptAll(listed).select(F.col("run").alias("place"), F.concat(F.lit("chunk not recorded: "), "id").alias("issue"))
    index_ = drift(chunks, index, "id", "text").select(F.col("run").alias("place"), F.concat(F.lit("index "), "issue", F.lit(": "), "id").alias("issue"))
    return digest(originals, "original").unionByName(digest(artifacts, "artifact")).unionByName(lacks).unionByName(more).unionByName(index_)


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the doomed ones, and children without those of doomed parents."""
    return parents.join(doomed.select(key), key, "left_anti"), children.join(doomed.select(F.col(key).alias(parent)), parent, "left_anti")


def fold_events(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Current state of each key: of every field the last value that isn't null."""
    at = F.struct(*order)
    return log.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields], F.count(F.lit(1)).alias("n_events"))


def next_number(log: DataFrame, number: str) -> int:
    """The number of the next experiment."""
    return (log.agg(F.max(number)).first()[0] or 0) + 1


def close_open(log: DataFrame, key: str, order: list[str], status: str, now: Column) -> DataFrame:
    """An event for each experiment that was started and never ended, as interrupted; to be appended to the log."""
    state = fold_events(log, key, order, [status])
    return state.where(F.col(status) == "started").select(key, F.lit("interrupted").alias(status), now.alias("at"))


#: Kinds of files that are taken, the largest size in bytes and the longest title.
KINDS, LARGEST, LONGEST_TITLE = ("pdf", "md", "json"), 100 << 20, 250


def ingest_issue(file: Column, size: Column, title: Column) -> Column:
    """Why a file isn't taken; null if it is."""
    kind = F.lower(F.regexp_extract(F.coalesce(file, F.lit("")), r"\.([^./]+)$", 1))
    name = F.length(F.trim(F.coalesce(title, F.lit(""))))
    return F.when(~kind.isin(*KINDS), "kind").when(F.coalesce(size, F.lit(LARGEST + 1)) > LARGEST, "size").when((name == 0) | (name > LONGEST_TITLE), "title")


def classify_ingest(incoming: DataFrame, catalog: DataFrame, title: str, digest: str, version: str, order: str) -> DataFrame:
    """Each incoming document as duplicate, new_version, alias or new, with its version, in the order of arrival (a distinct whole number).

    A title that is there gets a next version whenever its content changes. A title that isn't there is an alias, and stays
    out, while some other title's current content is the same; else it is new. So what an arrival is depends on earlier
    ones by its title and by its content. Each round counts, for the first undecided arrival of every title, the titles
    that surely and that possibly hold its content just then: none possibly makes it new, one surely an alias. The counts
    are running sums, whatever the number of titles that share a content; the earliest undecided arrival is always decided,
    and rounds grow only with chains of aliases that wait for each other.
    """
    old = latest_by(catalog, [title], [version], [digest]).select(F.col(title).alias("t"), F.col(digest).alias("d"), F.lit(None).cast("long").alias("at"), F.col(version).cast("long").alias("v"))
    came = incoming.select(F.col(title).alias("t"), F.col(digest).alias("d"), F.col(order).cast("long").alias("at"), F.lit(None).cast("long").alias("v"))
    per = Window.partitionBy("t").orderBy(F.asc_nulls_first("at"))
    # alive: whether the title is there from this arrival on; null: not known yet.
    rows = came.unionByName(old).withColumn("next", F.lead("at").over(per)).withColumn("own", F.max("v").over(per.rowsBetween(Window.unboundedPreceding, 0)).isNotNull())
    rows = staged(rows.withColumn("alive", F.when(F.col("own"), True)), "arrivals")
    earliest = F.lit(-(1 << 62))
    while rows.where("alive is null").limit(1).count():
        sure, maybe = F.coalesce("alive", F.lit(False)).cast("long"), F.coalesce("alive", F.lit(True)).cast("long")
        starts = rows.select("d", F.coalesce("at", earliest).alias("time"), F.lit(1).alias("last"), F.col("t"), sure.alias("sure"), maybe.alias("maybe"), F.lit(False).alias("asks"))
        ends = rows.where("next is not null").select("d", F.col("next").alias("time"), F.lit(0).alias("last"), F.col("t"), (-sure).alias("sure"), (-maybe).alias("maybe"), F.lit(False).alias("asks"))
        open_ = rows.where("alive is null").groupBy("t").agg(F.min("at").alias("time"), F.min_by("d", "at").alias("d"))
        asks = open_.select("d", "time", F.lit(-1).alias("last"), "t", F.lit(0).cast("long").alias("sure"), F.lit(0).cast("long").alias("maybe"), F.lit(True).alias("asks"))
        events = starts.unionByName(ends).unionByName(asks)
        held = prefix_sums(events, ["d"], [F.col("time"), F.col("last"), F.col("t")], {"n_sure": F.col("sure"), "n_maybe": F.col("maybe")}).where("asks")
        found = held.select(F.col("t").alias("_t"), F.col("time").alias("_at"), F.when(F.col("n_sure") > 0, False).when(F.col("n_maybe") == 0, True).alias("_alive")).where("_alive is not null")
        told = rows.join(found, F.col("t").eqNullSafe(F.col("_t")), "left")
        # A title that is there stays there; an alias decides only its own arrival.
        now = F.when(F.col("alive").isNull() & F.col("_alive") & (F.col("at") >= F.col("_at")), True).when(F.col("alive").isNull() & ~F.col("_alive") & (F.col("at") == F.col("_at")), False).otherwise(F.col("alive"))
        rows = staged(told.withColumn("alive", now).drop("_t", "_at", "_alive"), "arrivals")
    there = Window.partitionBy("t", "alive").orderBy(F.asc_nulls_first("at"))
    before = F.lag("d").over(there)
    first = F.row_number().over(there) == 1
    kind = F.when(~F.col("alive"), "alias").when(first, "new").when(before.eqNullSafe(F.col("d")), "duplicate").otherwise("new_version")
    base = F.coalesce(F.max("v").over(there.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    told = rows.withColumn("status", kind).withColumn("_base", base)
    number = F.col("_base") + F.sum((F.col("status") == "new_version").cast("long")).over(there)
    told = told.withColumn("version", F.when(F.col("alive"), number)).where("at is not null").select(F.col("at").alias("_at"), "status", "version")
    return incoming.join(told, F.col(order) == F.col("_at")).drop("_at")


def compare_keyed(saved: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Union of keys; a difference only where both sides have a number, equality only where both are present."""
    a, b = saved.select(F.col(key), F.col(value).alias("saved")), current.select(F.col(key), F.col(value).alias("current"))
    return a.join(b, key, "full_outer").select(key, "saved", "current", (F.col("current") - F.col("saved")).alias("diff"), (F.col("saved") == F.col("current")).alias("same"))


def chain_roots(links: DataFrame, node: str, parent: str) -> DataFrame:
    """Root and depth of each node of supersession chains, by pointer jumping: rounds grow with the logarithm of the longest chain. Nodes on a cycle keep a null root."""
    now = staged(links.select(F.col(node).alias("n"), F.col(parent).alias("up"), F.col(parent).isNotNull().cast("int").alias("d")), "chain")
    for _ in range(40):
        if now.where("up is not null").limit(1).count() == 0:
            break
        open_ = now.where("up is not null")  # settled nodes would all meet in the one task of the null key
        above = now.select(F.col("n").alias("_n"), F.col("up").alias("_up"), F.col("d").alias("_d"), F.coalesce("root", "n").alias("_r") if "root" in now.columns else F.col("n").alias("_r"))
        joined = open_.join(above, F.col("up") == F.col("_n"), "left")
        root = F.col("root") if "root" in now.columns else F.lit(None).cast(now.schema["n"].dataType)
        settled = now.where("up is null").select("n", "up", "d", root.alias("root"))
        now = staged(settled.unionByName(joined.select("n", F.col("_up").alias("up"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), F.when(F.col("up").isNotNull() & F.col("_up").isNull(), F.coalesce("_r", "up")).otherwise(root).alias("root"))), "chain")
    root = F.coalesce("root", "n") if "root" in now.columns else F.col("n")
    return now.select(F.col("n").alias(node), F.when(F.col("up").isNull(), root).alias("root"), F.col("d").alias("depth"))


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """U-S5: how many rows each side has beyond the other, repeated rows counted."""
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right")))


def discordant_pairs(rows: DataFrame, per: list[str], high: str, low: str, key: str) -> DataFrame:
    """Per group how many pairs (a, b) have a.high > b.high and a.low < b.low, and the least key of such an a, without forming the pairs.

    Values of `high` are numbered within the group. The numbers of a and b part at one highest bit, above which they agree:
    for each bit, the rows that agree above it are ordered by `low`, and each a (bit set) counts the b (not set) beyond it.
    """
    held = rows.where(" and ".join(f"`{c}` is not null" for c in (*per, high, low)))
    each = held.groupBy(*per, high, low).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_key"))
    numbers = global_rank(each.select(*per, high).distinct(), per, [F.col(high)], "_no").select(*[F.col(g).alias(f"_p{k}") for k, g in enumerate(per)], F.col(high).alias("_h"), "_no")
    same = F.col(high) == F.col("_h")
    for k, g in enumerate(per):
        same &= F.col(g) == F.col(f"_p{k}")
    each = staged(each.join(numbers, same).select(*per, low, "_no", "_n", "_key"), "numbered")
    bits = int(each.agg(F.max("_no")).first()[0] or 0).bit_length()
    if not bits:
        return each.groupBy(*per).agg(F.sum("_n").alias("n_discordant"), F.min("_key").alias("first"))
    level = each.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).withColumn("_set", F.expr("shiftright(_no, _bit) & 1"))
    level = level.withColumn("_above", F.expr("shiftright(_no, _bit + 1)"))
    # Of equal `low` the a come first, so that they don't count each other's equals.
    met = prefix_sums(level, [*per, "_bit", "_above"], [F.desc(low), F.desc("_set"), F.col("_no")], {"_met": F.when(F.col("_set") == 0, F.col("_n")).otherwise(0)})
    found = met.where("_set = 1 and _met > 0")
    return found.groupBy(*per).agg(F.sum(F.col("_n") * F.col("_met")).alias("n_discordant"), F.min("_key").alias("first"))


def numbered_blocks(rows: DataFrame, order: str, letter: str) -> DataFrame:
    """Report lines as citable blocks: their marks (R1, R2 ...) in order. A report has few lines."""
    return rows.withColumn("mark", F.concat(F.lit(letter), F.row_number().over(Window.orderBy(order)).cast("string")))


def conversation_list(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Conversations that aren't deleted, with the messages of the user and the assistant that are in context (by default they are) and not blank counted, the latest first."""
    counts = F.col("role").isin("user", "assistant") & F.coalesce("in_context", F.lit(True)) & (F.trim("text") != "")
    each = messages.where(~F.coalesce("deleted", F.lit(False))).groupBy(key).agg(F.count_if(counts).alias("n_messages"), F.max(order).alias("last_turn"))
    return global_rank(each, [], [F.desc("last_turn"), F.col(key)], "place")
