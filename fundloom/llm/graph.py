"""Connected components by alternating large-star and small-star steps, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import materialize


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest node that each linked node can reach.

    Links with a null end or two equal ends are ignored. Nodes without a link don't appear. Hot nodes are
    safe: minima are combined before the shuffle and written before they are joined, so that both sides of the
    joins are plain exchanges, which AQE can split.
    """
    stars = materialize(
        links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(),
        "links",
    )
    seen = None
    while True:
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if state == seen or not state[0]:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        seen = state
        both = stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        stars = materialize(large, "links")
        # Small star: below each node, everything points to its least neighbour.
        least = materialize(stars.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = stars.join(least, "hi").select(F.col("m"), F.explode(F.array("lo", "hi")).alias("hi")).where("m <> hi").select(F.col("m").alias("lo"), "hi").distinct()
        stars = materialize(small, "links")
