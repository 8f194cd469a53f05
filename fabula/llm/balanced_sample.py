"""Sample matching target category proportions (p6): the cube method.

The inclusion probability of an eligible record of label l is min(1, wanted_l / eligible_l). Flight phases run in every
partition on the label indicators: two undecided records of one label move against each other along the null space of
the indicators (which keeps every label's sum) until one of them is taken or left. At most one undecided record a label
and partition is left; these merge upward over levels of fewer partitions, flying again, and the landing decides the rest.
The report gives what could not be met and the residual imbalance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordsets import mix

MERGE = 16
EPS = 1e-9
TRUE = ("true", "1", "yes", "t")
#: Everything that Unicode counts as a blank at the ends of a value.
BLANKS = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"


def bare(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), BLANKS, "")


def eligible(records: DataFrame) -> DataFrame:
    """(doc_id, label) of records with a true pred_ok, once each; of several labels of one doc_id the least."""
    ok = F.lower(bare(F.col("pred_ok"))).isin(*TRUE)
    return records.where(ok & F.col("doc_id").isNotNull() & F.col("pred_label").isNotNull()).groupBy("doc_id").agg(F.min(F.upper(bare(F.col("pred_label")))).alias("label"))


def plan_table(records: DataFrame, targets: DataFrame) -> list:
    """Rows of targets with the wanted and the eligible number; as many rows as targets has, which is small."""
    counts = eligible(records).groupBy("label").count()
    label = F.upper(bare(F.col("pred_label")))
    wanted = F.greatest(F.coalesce("min_rows", F.lit(0)), F.round(F.coalesce(F.col("target_share"), F.lit(0.0)) * F.coalesce("sample_rows", F.lit(0))).cast("long"))
    rows = targets.select("plan_id", "pred_label", label.alias("label"), wanted.alias("wanted")).where("plan_id is not null and pred_label is not null")
    return rows.join(counts, "label", "left").select("plan_id", "pred_label", "label", "wanted", F.coalesce("count", F.lit(0)).alias("eligible")).orderBy("plan_id", "pred_label").collect()


def flight(p: np.ndarray, draw) -> tuple[np.ndarray, int]:
    """Flight on one label: the probabilities after it, and the undecided record (-1: none). draw(places, turn): random numbers.

    Undecided records move in pairs, all pairs at once: along (+1, -1), the null space of the label's indicator, up by
    min(1 - a, b) or down by min(a, 1 - b), so that the sum stays and the mean too. Each pair leaves one undecided at most.
    """
    p = p.copy()
    open_at, turn = np.flatnonzero((p > EPS) & (p < 1 - EPS)), 0
    while len(open_at) > 1:
        i, j = open_at[: len(open_at) // 2 * 2].reshape(-1, 2).T
        a, b = p[i], p[j]
        up, down = np.minimum(1 - a, b), np.minimum(a, 1 - b)
        step = np.where(draw(j, turn) * (up + down) < down, up, -down)
        p[i], p[j] = a + step, b - step
        near = (p[open_at] < EPS) | (p[open_at] > 1 - EPS)
        p[open_at[near]] = np.round(p[open_at[near]])
        open_at, turn = open_at[~near], turn + 1
    near = (p <= EPS) | (p >= 1 - EPS)
    p[near] = np.round(p[near])
    return p, int(open_at[0]) if len(open_at) else -1


def cube_sample(records: DataFrame, targets: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sample, report): sample (plan_id, pred_label, doc_id); report (plan_id, pred_label, wanted, eligible, drawn, short, residual).

    records: doc_id, pred_label, pred_ok; targets: plan_id, pred_label, target_share, min_rows, sample_rows. wanted is the
    larger of min_rows and target_share x sample_rows rounded to a whole number (half up); null parts count as zero. A
    label with fewer eligible records gives all of them; short is what the draw lacks of wanted. residual is drawn minus the
    number that could be wanted. A doc_id counts once; null labels and ids never do; empty tables give empty results or a
    report of nothing drawn. The draw depends on the seed and doc_id only through their hash and the partitioning.
    """
    spark = records.sparkSession
    plans = plan_table(records, targets)
    goals: dict[str, list[tuple[int, str, float]]] = {}
    for r in plans:
        if r.wanted > 0 and r.eligible > 0:
            goals.setdefault(r.label, []).append((r.plan_id, r.pred_label, min(1.0, r.wanted / r.eligible)))
    schema = "plan_id int, pred_label string, doc_id long, p double"

    def pack(plan, label, ids, p):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, plan, np.int32)), pa.array([label] * n, pa.string()), pa.array(ids, pa.int64()), pa.array(p, pa.float64())], ["plan_id", "pred_label", "doc_id", "p"])

    def draw(plan: int, ids: np.ndarray, level: int):
        return lambda at, turn: (mix(ids[at].view(np.uint64), 1000 * seed + plan * 31 + level + 100_000 * turn) >> np.uint64(11)).astype(np.float64) / 2**53

    def fly(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list[np.ndarray]] = {}
        for b in batches:
            ids, label = np.asarray(b.column("doc_id")), np.asarray(b.column("label").to_pylist(), object)
            for x in set(label) & goals.keys():
                held.setdefault(x, []).append(ids[label == x])
        for x in sorted(held):
            ids = np.concatenate(held[x])
            for plan, name, p in goals[x]:
                order = np.argsort(mix(ids.view(np.uint64), seed + plan), kind="stable")
                q, _ = flight(np.full(len(ids), p), draw(plan, ids[order], 0))
                at = q > EPS
                yield pack(plan, name, ids[order][at], q[at])

    def again(batches: Iterator[pa.RecordBatch]):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("plan_id", "pred_label", "doc_id", "p")))]
        by: dict[tuple, list] = {}
        for plan, name, i, p in rows:
            by.setdefault((plan, name), []).append((i, p))
        for (plan, name), some in sorted(by.items()):
            ids, p = np.array([i for i, _ in some], np.int64), np.array([q for _, q in some])
            order = np.argsort(mix(ids.view(np.uint64), seed + plan), kind="stable")
            q, last = flight(p[order], draw(plan, ids[order], 1))
            at = q > EPS
            yield pack(plan, name, ids[order][at], q[at])

    from ..session import cut

    # the flight costs more than its bytes tell: tasks by the number of records
    parts = max(spark.sparkContext.defaultParallelism, sum({r.label: r.eligible for r in plans}.values()) // 50_000)
    first = cut(eligible(records.select("doc_id", "pred_label", "pred_ok").repartition(parts, "doc_id")).mapInArrow(fly, schema))
    taken, open_rows = [first.where(F.col("p") >= 1 - EPS)], first.where(F.col("p") < 1 - EPS)
    while True:
        parts = max(1, parts // MERGE)
        moved = cut(open_rows.repartition(parts).mapInArrow(again, schema))
        taken.append(moved.where(F.col("p") >= 1 - EPS))
        open_rows = moved.where(F.col("p") < 1 - EPS)
        if parts == 1:
            break
    # landing: the one record a label that rounding may have left is decided by its probability
    taken.append(open_rows.where(F.col("p") >= 0.5))
    sample = taken[0]
    for t in taken[1:]:
        sample = sample.unionByName(t)
    sample = sample.select("plan_id", "pred_label", "doc_id")
    table = spark.createDataFrame([(r.plan_id, r.pred_label, r.wanted, r.eligible) for r in plans], "plan_id int, pred_label string, wanted long, eligible long")
    drawn = sample.groupBy("plan_id", "pred_label").agg(F.count("*").alias("drawn"))
    report = table.join(drawn, ["plan_id", "pred_label"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    report = report.withColumn("short", F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0))).withColumn("residual", F.col("drawn") - F.least("wanted", "eligible"))
    return sample, report
