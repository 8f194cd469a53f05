"""Splits that keep related records together (p3): frontier breadth-first components over accident links, then a split by
component hash order within strata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components

#: Hash cells per stratum whose sizes reach the driver (the result doesn't depend on it).
CELLS = 1024


def accident_key(c: Column) -> Column:
    """ACC- plus the nine digits of an accident id, however it is written; null if there aren't nine."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) == 9, F.concat(F.lit("ACC-"), digits))


def accident_components(links: DataFrame) -> DataFrame:
    """(accident_id, component) of all accidents in links (accident_id_a, accident_id_b); unreadable ids link nothing."""
    pairs = links.select(accident_key(F.col("accident_id_a")).alias("a"), accident_key(F.col("accident_id_b")).alias("b"))
    return components(pairs).withColumnRenamed("node", "accident_id")


def split_leaks(records: DataFrame, links: DataFrame) -> DataFrame:
    """(accident_id): accidents whose records, with those of all linked accidents, carry more than one split.

    records: accident_id, split_name. A null split is no split; rows without a readable accident belong to none; rows
    delivered again change nothing; links to accidents without records still connect; empty tables give an empty result.
    """
    own = records.select(accident_key(F.col("accident_id")).alias("accident_id"), "split_name").where("accident_id is not null")
    own = own.groupBy("accident_id").agg(F.min("split_name").alias("low"), F.max("split_name").alias("high"))
    own = own.join(accident_components(links), "accident_id", "left").withColumn("component", F.coalesce("component", "accident_id"))
    mixed = own.groupBy("component").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("component")
    return own.join(mixed, "component", "left_semi").select("accident_id")


def linked_splits(records: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, component, split_name): every record in one split, whole components together, in the shares of targets.

    records: doc_id, accident_id, pred_label; targets: split_name, target_share (few rows, any positive scale). A record
    without readable accident is a component of its own. A doc_id counts once, rows without one are left out. Components
    are ordered by hash within the stratum of their most frequent label (ties: the least; null if they have none), and the
    running number of records decides the split, so that shares hold in each stratum up to the size of a component. Empty
    tables give an empty result.
    """
    spark = records.sparkSession
    docs = records.where("doc_id is not null").groupBy("doc_id").agg(F.min(accident_key(F.col("accident_id"))).alias("accident_id"), F.min(F.upper(F.trim("pred_label"))).alias("label"))
    docs = docs.join(accident_components(links), "accident_id", "left").withColumn("component", F.coalesce("component", "accident_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))))
    counts = docs.groupBy("component", "label").count()
    sizes = counts.groupBy("component").agg(F.sum("count").alias("n"), F.max(F.when(F.col("label").isNotNull(), F.struct("count", F.col("label")))).alias("m")).select("component", "n", F.when(F.col("m.label").isin("A0", "A1", "B", "C"), F.col("m.label")).otherwise("other").alias("stratum"))
    sizes = sizes.withColumn("h", F.xxhash64("component")).withColumn("cell", F.pmod("h", F.lit(CELLS)).cast("int"))
    # running totals: cells of bounded number on the driver, within a cell by a window
    totals = {(r.stratum, r.cell): r.n for r in sizes.groupBy("stratum", "cell").agg(F.sum("n").alias("n")).collect()}
    starts, whole = [], {}
    for s, c in sorted(totals):
        starts.append((s, c, whole.get(s, 0)))
        whole[s] = whole.get(s, 0) + totals[s, c]
    shares = sorted((r.split_name, float(r.target_share)) for r in targets.where("split_name is not null and target_share > 0").collect())
    total = sum(x for _, x in shares)
    if not starts or not total:
        return spark.createDataFrame([], "doc_id long, component string, split_name string")
    base = F.broadcast(spark.createDataFrame([(s, c, int(n), int(whole[s])) for s, c, n in starts], "stratum string, cell int, start long, whole long"))
    w = Window.partitionBy("stratum", "cell").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.join(base, ["stratum", "cell"]).withColumn("middle", (F.col("start") + F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("n") / 2) / F.col("whole") * total)
    edge, expr = 0.0, None
    for name, share in shares:
        edge += share
        expr = F.when(F.col("middle") < edge, name) if expr is None else expr.when(F.col("middle") < edge, name)
    return docs.join(placed.select("component", expr.otherwise(shares[-1][0]).alias("split_name")), "component").select("doc_id", "component", "split_name")
