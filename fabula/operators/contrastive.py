"""Contrastive losses on batches of vectors, evaluated for given vectors and centres.

A batch is a stated small set (the training batch size, tens of rows); pairs are formed within a batch only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot


def squared_gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def batch_pairs(rows: DataFrame) -> DataFrame:
    """(batch, i, j, positive, gap, cos) of the ordered pairs within each batch; rows: batch, doc_id, label, embedding."""
    a = rows.select("batch", F.col("doc_id").alias("i"), F.col("label").alias("li"), F.col("embedding").alias("x"))
    b = rows.select("batch", F.col("doc_id").alias("j"), F.col("label").alias("lj"), F.col("embedding").alias("y"))
    p = a.join(b, "batch").where("i <> j")
    return p.select("batch", "i", "j", (F.col("li") == F.col("lj")).alias("positive"), squared_gap(F.col("x"), F.col("y")).alias("gap"), dot(F.col("x"), F.col("y")).alias("cos"))


def supcon(pairs: DataFrame, temperature: float = 0.1, euclidean: bool = True) -> DataFrame:
    """(batch, loss): minus the mean, over anchors with positives, of the mean log share of positives. Pairs of a row with
    itself never count."""
    logit = (-F.col("gap") if euclidean else F.col("cos")) / temperature
    p = pairs.withColumn("l", logit)
    top = p.groupBy("batch", "i").agg(F.max("l").alias("m"))
    norm = p.join(top, ["batch", "i"]).groupBy("batch", "i").agg((F.first("m") + F.ln(F.sum(F.exp(F.col("l") - F.col("m"))))).alias("z"), F.avg(F.when(F.col("positive"), F.col("l"))).alias("pos"))
    return norm.where("pos is not null").groupBy("batch").agg((-F.avg(F.col("pos") - F.col("z"))).alias("loss"))


def triplet_hard(pairs: DataFrame, margin: float = 0.5) -> DataFrame:
    """(batch, loss): mean over anchors with both of relu(hardest positive distance - hardest negative distance + margin)."""
    far = F.sqrt("gap")
    h = pairs.groupBy("batch", "i").agg(F.max(F.when(F.col("positive"), far)).alias("p"), F.min(F.when(~F.col("positive"), far)).alias("n"))
    return h.where("p is not null and n is not null").groupBy("batch").agg(F.avg(F.greatest(F.col("p") - F.col("n") + margin, F.lit(0.0))).alias("loss"))


def soft_triple(rows: DataFrame, centres: DataFrame, gamma: float = 0.1, scale: float = 20.0, delta: float = 0.01, tau: float = 0.2, gap: float = 0.3) -> DataFrame:
    """One row (loss): rows (doc_id, label, embedding) against centres (label, k, centre), a few a label. Each batch of rows is
    one matrix product with the centres; a task returns a count and a sum. Null without rows whose label has a centre."""
    import numpy as np
    import pyarrow as pa

    table = centres.orderBy("label", "k").collect()  # labels x centres rows
    names = sorted({r["label"] for r in table})
    c = np.array([r["centre"] for r in table], np.float64).reshape(len(table), -1)
    of = np.array([names.index(r["label"]) for r in table], np.int64)
    first = np.searchsorted(of, np.arange(len(names)))

    def sums(batches):
        n, total = 0, 0.0
        for b in batches:
            label = np.array([names.index(x) if x in names else -1 for x in b.column("label").to_pylist()], np.int64)
            x = np.asarray(b.column("embedding").flatten(), np.float64).reshape(b.num_rows, -1)[label >= 0]
            label = label[label >= 0]
            if not len(x):
                continue
            s = 2 * x @ c.T - (x * x).sum(1, keepdims=True) - (c * c).sum(1)
            e = np.exp((s - np.maximum.reduceat(s, first, axis=1)[:, of]) / gamma)
            logit = scale * np.add.reduceat(e * s, first, axis=1) / np.add.reduceat(e, first, axis=1)
            at = np.arange(len(x))
            logit[at, label] -= scale * delta
            top = logit.max(1)
            total += float((top + np.log(np.exp(logit - top[:, None]).sum(1)) - logit[at, label]).sum())
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total])], ["n", "total"])

    ce = rows.where(F.col("embedding").isNotNull()).select("label", "embedding").mapInArrow(sums, "n long, total double").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("ce"))
    pulls = []
    for k in range(len(names)):
        mine = c[of == k]
        i, j = np.triu_indices(len(mine), 1)
        if len(i):
            pulls.append(float((np.maximum(gap - np.linalg.norm(mine[i] - mine[j], axis=1), 0) ** 2).mean()))
    return ce.select((F.col("ce") + tau * (float(np.mean(pulls)) if pulls else 0.0)).alias("loss"))
