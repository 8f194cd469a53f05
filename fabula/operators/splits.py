"""Grouped folds and hold-outs, stratified samples, fold tables, parameter grids."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_folds(df: DataFrame, group: str, n: int, seed: int = 42, greedy: bool = True) -> DataFrame:
    """M18. df with fold 0..n-1, whole groups together.

    greedy: buckets of groups (4096 by hash, however many groups there are) are dealt, heaviest first, to the lightest fold,
    so that the driver sees 4096 sizes at most; else a plain hash. Null groups are one group.
    """
    if n < 2:
        return df.withColumn("fold", F.lit(0))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col(group).cast("string"), F.lit(""))), F.lit(4096)).cast("int")
    held = df.withColumn("_bucket", bucket)
    if not greedy:
        return held.withColumn("fold", F.pmod("_bucket", F.lit(n)).cast("int")).drop("_bucket")
    load, deal = [0] * n, []
    for r in sorted(held.groupBy("_bucket").count().collect(), key=lambda r: (-r["count"], r["_bucket"])):
        k = min(range(n), key=lambda i: (load[i], i))
        load[k] += r["count"]
        deal.append((r["_bucket"], k))
    folds = F.broadcast(df.sparkSession.createDataFrame(deal, "_bucket int, fold int"))  # 4096 rows at most
    return held.join(folds, "_bucket").drop("_bucket")


def hold_out(df: DataFrame, group: str, ratio: float, seed: int = 42) -> DataFrame:
    """M19. df with is_validation: the ceil(ratio x groups) groups of least hash."""
    groups = df.select(F.col(group)).where(F.col(group).isNotNull()).distinct().withColumn("_h", F.xxhash64(F.lit(seed), F.col(group).cast("string")))
    take = F.ceil(F.lit(ratio) * groups.count()).cast("long")
    # the hash below which so many groups lie: by cells first, so that no task sorts all groups
    cells = groups.withColumn("_cell", F.shiftright("_h", 52)).groupBy("_cell").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")  # 4096 cells
    placed = groups.withColumn("_cell", F.shiftright("_h", 52)).join(F.broadcast(cells), "_cell").withColumn("_p", F.row_number().over(Window.partitionBy("_cell").orderBy("_h", group)) + F.col("_before"))
    return df.join(placed.select(group, (F.col("_p") <= take).alias("is_validation")), group, "left").withColumn("is_validation", F.coalesce("is_validation", F.lit(False)))


def stratified_sample(df: DataFrame, label: str, most: int, seed: int = 42) -> DataFrame:
    """W5, O5. At most most/4 rows a label, by hash, then at most `most` rows."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    slices = Window.partitionBy(label, F.pmod(h, F.lit(64))).orderBy(h, "doc_id")
    some = df.withColumn("_r", F.row_number().over(slices)).where(F.col("_r") <= most // 4)
    kept = some.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(h, "doc_id"))).where(F.col("_r") <= most // 4)
    return kept.drop("_r").orderBy(h, "doc_id").limit(most)


def capped(rows: DataFrame, most: int, *order) -> DataFrame:
    """O4. The first rows of a total order."""
    return rows.orderBy(*order).limit(most)


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """A22. (metric, mean, std, n): sample deviation over folds, 0 for a single one; values that are no numbers don't count."""
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    long = folds.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), number(m).alias("v")) for m in metrics])).alias("t")).select("t.*").where("v is not null")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.count("*").alias("n"))


def best_epoch(log: DataFrame, *keys: str, metric: str = "eta2_perc", penalty: str | None = None, weight: float = 0.0) -> DataFrame:
    """W8. The epoch of highest score for each key, ties to the earliest; undefined scores are lowest."""
    score = F.coalesce(F.nanvl(F.col(metric), F.lit(None).cast("double")), F.lit(float("-inf")))
    if penalty:
        score = score - weight * F.coalesce(F.col(penalty), F.lit(0.0))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "epoch")
    return log.withColumn("score", score).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def epoch_loss(steps: DataFrame) -> DataFrame:
    """A40. (epoch, loss): mean of the steps whose fractional epoch rounds up to it."""
    return steps.where("loss is not null").groupBy(F.ceil("epoch").cast("int").alias("epoch")).agg(F.avg("loss").alias("loss"))


def last_values(log: DataFrame) -> DataFrame:
    """W6. (metric, value): the value of the last epoch that has one."""
    return log.where("value is not null").groupBy("metric").agg(F.max_by("value", "epoch").alias("value"))


def leaderboard(rows: DataFrame, metric: str) -> DataFrame:
    """W9, O1. Rows with place by a metric, best first, undefined last, then by method."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.nanvl(F.col(metric), F.lit(None).cast("double"))), "method")))  # a row a method


def unpivoted(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """P20. (key, metric, value)."""
    return rows.unpivot(key, metrics, "metric", "value")


def grid(params: dict[str, list]) -> list[dict]:
    """M25, H20. All combinations in order, each with an id of sorted names, numbers short, 120 characters at most."""
    names = sorted(params)
    out = []
    for values in itertools.product(*(params[n] for n in names)):
        show = [f"{n.rsplit('.', 1)[-1]}={f'{v:.0e}' if isinstance(v, float) else v}" for n, v in zip(names, values)]
        out.append(dict(zip(names, values)) | {"combo": "_".join(show)[:120]})
    return out


def grid_frame(spark, params: dict[str, list]) -> DataFrame:
    """M25 as a cross join of parameter tables; a few values each."""
    out = None
    for n in sorted(params):
        t = spark.createDataFrame([(v,) for v in params[n]], [n])
        out = t if out is None else out.crossJoin(t)
    return out


def best_combo(results: DataFrame, metric: str) -> DataFrame:
    """W10. The combination of highest metric, undefined lowest, ties by name."""
    return results.orderBy(F.desc(F.coalesce(F.nanvl(F.col(metric), F.lit(None).cast("double")), F.lit(float("-inf")))), "combo").limit(1)
