"""Connected components by DataFrame joins: smallest labels spread along links, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, staged

#: Hubs that may be broadcast: 12 bytes each.
BROADCAST_HUBS = 1_000_000
#: Links of an id beyond which they are joined in parts of about as many.
HUB_LINKS = 100_000


def _spread(both: DataFrame, hubs: DataFrame | None, labels: DataFrame) -> DataFrame:
    """id, label: each id with the labels of its neighbours."""
    told = labels.select(F.col("id").alias("b"), "label")
    if hubs is None:
        return both.join(told, "b").select(F.col("a").alias("id"), "label")
    # the links of a hub lie in parts, and its label goes to each of them
    parts = told.join(hubs, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).select("b", "label", "part")
    return both.join(parts, ["b", "part"]).select(F.col("a").alias("id"), "label")


def components(links: DataFrame, hub_links: int = HUB_LINKS) -> DataFrame:
    """links: a, b (numbers, either order, repeats allowed; links with a null are left out). Returns id, label: the smallest id that links reach, for each
    linked id; no row for an empty table.

    Each round takes for every id the least label of itself and its neighbours, then the label of that label, so rounds
    grow with the logarithm of a chain's length. The links of an id with more than hub_links of them are dealt into parts by their other end, so no
    task joins all of them; minima are taken where links lie before they move. A label that very many ids share is left to adaptive execution's split of skewed joins. Labels are written to the shared folder after each round."""
    both = staged(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    degrees = both.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("least"))
    hubs = staged(degrees.where(F.col("n") > hub_links).select("b", F.ceil(F.col("n") / hub_links).cast("int").alias("parts")), "hubs")
    dealt, split = both, None
    if not hubs.isEmpty():
        split = hubs
        some = F.broadcast(hubs) if hubs.count() <= BROADCAST_HUBS else hubs
        dealt = staged(both.join(some, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0)).cast("int").alias("part")), "links")
    labels = staged(degrees.select(F.col("b").alias("id"), F.least("b", "least").alias("label")), "labels")
    while True:
        spread = _spread(dealt, split, labels).unionByName(labels.select("id", "label"))
        least = spread.groupBy("id").agg(F.min("label").alias("label"))
        far = least.select(F.col("id").alias("label"), F.col("label").alias("further"))
        jumped = staged(least.join(far, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        moved = jumped.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old")
        still = moved.isEmpty()
        dropped(labels)
        labels = jumped
        if still:
            dropped(both), dropped(hubs)
            if split is not None:
                dropped(dealt)
            return labels
