"""Problem 4: the N best items of every group, by descending score bands.

The score range is cut into bands. The bands are worked through from the top; groups that already hold N items are
left out of all further bands by an anti-join, so most rows of large groups are never shuffled. In a band, ties
are ranked exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tanmono.plans.storage import materialize, release

#: Share of all scores above the lower edge of each band; the last band has no lower edge.
BANDS = (0.02, 0.08, 0.3, 1.0)


def top_per_group(df: DataFrame, group: str, item: str, score: str, n: int, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(group_id, item_id, score, position): the n best items of each group, all if it has fewer.

    Higher score first, then smaller item. Rows with a null group or item or a null or NaN score are left out; an item
    given more than once in a group counts once, with its highest score. Inside a band Spark keeps at most n rows
    of a group per map task before they cross the network (a window group limit), so no task sees a whole group.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
    rows = rows.filter("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    shares = F.array(*(F.lit(1.0 - b) for b in bands[:-1]))
    facts = rows.agg(F.percentile_approx("s", shares, 10_000).alias("cuts"), F.count_distinct("g").alias("groups")).first()
    cuts = sorted(set(facts["cuts"] or ()), reverse=True)
    best = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i"))
    taken: list[DataFrame] = []
    filled = None
    for lower, upper in zip([*cuts, None], [None, *cuts], strict=True):
        band = rows if upper is None else rows.filter(F.col("s") < upper)
        band = band if lower is None else band.filter(F.col("s") >= lower)
        if filled is not None:
            band = band.join(filled, "g", "left_anti")
        band = band.groupBy("g", "i").agg(F.max("s").alias("s"))
        if taken:
            band = band.join(reduce(DataFrame.unionByName, taken).select("g", "i"), ["g", "i"], "left_anti")
        taken.append(materialize(band.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= n).drop("r"), "band"))
        if lower is not None:
            counts = reduce(DataFrame.unionByName, taken).groupBy("g").agg(F.count("*").alias("n"))
            before, filled = filled, materialize(counts.filter(F.col("n") >= n).select("g"), "filled")
            release(df.sparkSession, *([before] if before is not None else []))
            if filled.count() == facts["groups"]:
                break
    ranked = reduce(DataFrame.unionByName, taken).withColumn("position", F.row_number().over(best)).filter(F.col("position") <= n)
    return ranked.select(F.col("g").alias("group_id"), F.col("i").alias("item_id"), F.col("s").alias("score"), "position")
