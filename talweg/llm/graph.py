"""Connected components of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Links that one task handles, about: few links needn't be spread over all shuffle partitions in every round.
LINKS = 100_000


def components(links: DataFrame) -> DataFrame:
    """(v, c): the least vertex of the component of each vertex of links (a, b). Labels spread to neighbours and jump to the label's label, so rounds grow with the logarithm of a component's diameter."""
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    n = max(1, -(-both.count() // LINKS))
    both = both.coalesce(n)
    labels = staged(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")).coalesce(n), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("n"))
        spread = staged(labels.join(near, "v").select("v", F.least("c", "n").alias("c"), F.col("c").alias("was")).coalesce(n), "labels")
        up = spread.select(F.col("v").alias("p"), F.col("c").alias("pc"))
        jumped = staged(spread.join(up, F.col("c") == F.col("p"), "left").select("v", F.least("c", F.coalesce("pc", "c")).alias("c"), "was").coalesce(n), "labels")
        labels = jumped.select("v", "c")
        if jumped.where("c <> was").limit(1).count() == 0:
            return labels


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components (v, c) after further links (a, b): only the components that these touch are joined anew."""
    label = lambda side: known.select(F.col("v").alias(f"v{side}"), F.col("c").alias(f"c{side}"))
    ends = links.join(label("a"), F.col("a") == F.col("va"), "left").join(label("b"), F.col("b") == F.col("vb"), "left")
    pairs = staged(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "component-links")
    if not pairs.limit(1).count():
        return known
    new = components(pairs)
    old = known.unionByName(new.select("v", F.col("v").alias("c"))).groupBy("v").agg(F.min("c").alias("c"))
    return staged(old.join(new.select(F.col("v").alias("w"), F.col("c").alias("n")), F.col("c") == F.col("w"), "left").select("v", F.coalesce("n", "c").alias("c")), "components")
