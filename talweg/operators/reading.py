"""Which pages of which documents are read within a budget (K07): selection over pinned and found documents, and picks of single pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fitting_blocks
from ..storage import staged
from .ranking import share_budget

#: The share of a budget that a found document grows to before others are served again, and the pages that are picked at most.
CAP, MOST_PAGES = 0.25, 12


def selected_blocks(documents: DataFrame, blocks: DataFrame, plan: str, doc: str, position: str, budget: int, cap: float = CAP) -> DataFrame:
    """(plan, doc, block): the blocks of each document of a plan that are read.

    documents: plan, doc, position, pinned; blocks: plan, doc, block, cost, found_rank (null where the search found nothing).
    Pinned documents get all they need first, found ones the block of their best find, then up to the cap, then what is
    left, in order. A document whose share is its whole cost is read whole; else its found blocks go first, then their
    neighbours outwards, as long as they fit. A pinned document without a find starts with its first block.
    """
    best = F.min_by("cost", F.struct("found_rank", "block"))
    found = blocks.where("found_rank is not null").groupBy(plan, doc).agg(best.alias("floor"))
    asks = blocks.groupBy(plan, doc).agg(F.sum("cost").cast("long").alias("want")).join(found, [plan, doc], "left").join(documents.select(plan, doc, position, "pinned"), [plan, doc])
    asks = asks.withColumn("floor", F.coalesce("floor", F.lit(0)).cast("long"))
    # Pinned ones come first in their plan, whatever their position.
    shares = share_budget(asks.withColumn("_first", (~F.col("pinned")).cast("int")), ["_first", position, doc], "want", "floor", budget, cap, [plan]).where("granted > 0")
    costed = blocks.join(shares.select(plan, doc, "want", "granted"), [plan, doc])
    whole = costed.where("granted >= want").select(plan, doc, "block")
    part = costed.where("granted < want").select(plan, doc, "block", F.col("cost").cast("double").alias("cost"), F.col("found_rank").cast("double").alias("found_rank"), F.col("granted").cast("double").alias("granted"))
    # The growth of a document depends on what was chosen of it, not on other documents: each gets a number of its own.
    names = staged(shares.where("granted < want").select(plan, doc).withColumn("_k", F.monotonically_increasing_id()), "partly-read")
    grown = fitting_blocks(part.join(names, [plan, doc]), "_k", "block", "cost", "found_rank", "granted")
    return whole.unionByName(grown.join(names, "_k").select(plan, doc, "block"))


def picked_pages(wanted: DataFrame, pages: DataFrame, taken: DataFrame, plan: str, doc: str, page: str, priority: str, budget: int, most: int = MOST_PAGES) -> DataFrame:
    """(plan, doc, page, place): single pages by priority while they fit: a page that is too dear is passed over, later ones may still fit.

    wanted: plan, priority, doc, page (a workload's hits, few a plan); pages: plan, doc, page, cost; taken: plan, doc, tokens
    of documents that are read already (none of their pages is picked).
    """
    spent = taken.groupBy(plan).agg(F.sum("tokens").alias("_spent"))
    known = wanted.select(plan, doc, page, priority).join(taken.select(plan, doc), [plan, doc], "left_anti").join(pages.select(plan, doc, page, "cost"), [plan, doc, page])
    once = known.groupBy(plan, doc, page).agg(F.min(priority).alias("_p"), F.min("cost").cast("long").alias("_c"))
    row = F.struct(F.col("_p"), F.col(doc).alias("doc"), F.col(page).alias("page"), F.col("_c").alias("cost"))
    asked = once.groupBy(plan).agg(F.array_sort(F.collect_list(row)).alias("_rows")).join(spent, plan, "left")

    def take(state: Column, x: Column) -> Column:
        fits = (x["cost"] <= state["left"]) & (F.size(state["got"]) < most)
        got = F.struct(x["doc"].alias("doc"), x["page"].alias("page"))
        return F.when(fits, F.struct((state["left"] - x["cost"]).alias("left"), F.concat(state["got"], F.array(got)).alias("got"))).otherwise(state)

    kinds = f"array<struct<doc: {wanted.schema[doc].dataType.simpleString()}, page: {wanted.schema[page].dataType.simpleString()}>>"
    start = F.struct((F.lit(budget).cast("long") - F.coalesce("_spent", F.lit(0)).cast("long")).alias("left"), F.array().cast(kinds).alias("got"))
    done = asked.select(plan, F.posexplode(F.aggregate("_rows", start, take)["got"]).alias("_i", "_g"))
    return done.select(plan, F.col("_g.doc").alias(doc), F.col("_g.page").alias(page), (F.col("_i") + 1).alias("place"))
