"""Interval labels of a tree of collections, so that "a folder and all below it" is a range.

The labels are places in a walk around the tree, which goes down into each folder and up out of it once. Every step of the
walk knows the next one from its siblings and parent alone; then pointers double, as in list ranking: after some rounds each step knows how many are
left. So the rounds grow with the logarithm of the number of folders, whatever the tree's depth, and no task sees a whole branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..store import written


def interval_labels(collections: DataFrame, key: str = "guid", parent: str = "parent", order: list | None = None) -> DataFrame:
    """The collections with ``low`` and ``high``: a folder is below another if its ``low`` lies between the other's two.

    Siblings follow each other in the given order, else by key. Folders whose parent is null or absent are roots; rows without a key are left out, of
    rows with one key the one with the smallest parent counts; folders on or below a circle have null labels."""
    rows = collections.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(parent).alias("p"), F.min(F.struct(*(order or [F.col(key)]))).alias("o"))
    there = rows.select(F.col("k").alias("p"), F.lit(True).alias("_there"))
    rows = written(rows.join(there, "p", "left").select("k", F.when(F.col("_there"), F.col("p")).alias("p"), "o"), "tree")
    siblings = Window.partitionBy("p").orderBy("o", "k")
    near = rows.select("k", "p", F.lead("k").over(siblings).alias("next"), F.row_number().over(siblings).alias("n"))
    # all roots share one window: a row for each root
    first = near.where("n = 1 and p is not null").select(F.col("p").alias("k"), F.col("k").alias("child"))
    near = near.join(first, "k", "left")
    step = lambda k, up: F.struct(k.alias("k"), F.lit(up).alias("up"))
    down = near.select(step(F.col("k"), False).alias("at"), F.when(F.col("child").isNotNull(), step(F.col("child"), False)).otherwise(step(F.col("k"), True)).alias("to"))
    out = F.when(F.col("next").isNotNull(), step(F.col("next"), False)).when(F.col("p").isNotNull(), step(F.col("p"), True))
    walk = down.unionByName(near.select(step(F.col("k"), True).alias("at"), out.alias("to"))).withColumn("left", F.col("to").isNotNull().cast("long"))
    walk, size = written(walk, "walk"), 2 * rows.count()
    reach = 1
    while reach < size and not walk.where("to is not null").isEmpty():
        ahead = walk.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("left").alias("_left"))
        walk = walk.join(ahead, "to", "left").select("at", F.col("_to").alias("to"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left"))
        walk, reach = written(walk, "walk"), 2 * reach
    place = F.when(F.col("to").isNull(), F.lit(size) - 1 - F.col("left"))
    ends = walk.groupBy(F.col("at.k").alias(key)).agg(F.min(F.when(~F.col("at.up"), place)).alias("low"), F.min(F.when(F.col("at.up"), place)).alias("high"))
    return collections.drop("low", "high").join(ends, key, "left")


def below(labelled: DataFrame, folder, key: str = "guid") -> DataFrame:
    """Keys of a folder and of all folders below it."""
    found = labelled.where(F.col(key) == F.lit(folder)).select("low", "high").first()
    if found is None or found["low"] is None:
        return labelled.where(F.col(key) == F.lit(folder)).select(key)
    return labelled.where(F.col("low").between(found["low"], found["high"])).select(key)


def members_below(publications: DataFrame, bridge: DataFrame, labelled: DataFrame, folder) -> DataFrame:
    """Publications (guid) that are in a folder or anywhere below it, each once."""
    inside = bridge.join(below(labelled, folder).withColumnRenamed("guid", "collection_guid"), "collection_guid", "left_semi")
    return publications.join(inside.select(F.col("publication_guid").alias("guid")), "guid", "left_semi")
