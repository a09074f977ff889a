"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import cut, release


def _least(sym: DataFrame) -> DataFrame:
    return sym.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v: of one type that has an order); label is the least node that it reaches.

    Null ends and loops are ignored, repeated edges count once, no edges give no
    rows. Each round is written to the shared folder, so plans stay short and a
    lost executor costs one round.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        before, now = now, cut(small.where("u <> v").distinct(), "edges")
        release(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
