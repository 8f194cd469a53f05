"""Agreement of two labellings from their contingency table, and label shifts between models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MACROS


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of rows with both."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _margins(c: DataFrame) -> DataFrame:
    xlogx = lambda x: F.sum(F.col(x) * F.ln(F.col(x)))
    pairs = lambda x: F.sum(F.col(x) * (F.col(x) - 1) / 2)
    a, b = c.groupBy("a").agg(F.sum("n").alias("n")), c.groupBy("b").agg(F.sum("n").alias("n"))
    j = c.agg(F.sum("n").cast("double").alias("n"), xlogx("n").alias("hj"), pairs("n").alias("pj"))
    for one, s in ((a, "a"), (b, "b")):
        j = j.crossJoin(F.broadcast(one.agg(xlogx("n").alias(f"h{s}"), pairs("n").alias(f"p{s}"), F.count("*").alias(f"k{s}"))))  # one row each
    return j


def nmi_ari(rows: DataFrame, a: str, b: str) -> DataFrame:
    """A30, A31. One row: n, nmi (arithmetic mean), ari, homogeneity of clusters b against classes a. Null without rows."""
    m = _margins(contingency(rows, a, b))
    n = F.col("n")
    h = lambda s: F.ln(n) - F.col(f"h{s}") / n
    mutual = h("a") + h("b") - h("j")
    mean = (h("a") + h("b")) / 2
    expected = F.col("pa") * F.col("pb") / F.nullif(n * (n - 1) / 2, F.lit(0.0))
    top = (F.col("pa") + F.col("pb")) / 2
    return m.select(
        n.cast("long").alias("n"),
        F.when(mean > 1e-12, F.greatest(mutual / mean, F.lit(0.0))).otherwise(F.lit(1.0)).alias("nmi"),
        F.coalesce(F.try_divide(F.col("pj") - expected, top - expected), F.lit(1.0)).alias("ari"),
        F.when(h("a") > 1e-12, 1 - (h("j") - h("b")) / h("a")).otherwise(F.lit(1.0)).alias("homogeneity"),
    )


def purity(rows: DataFrame, a: str, b: str) -> DataFrame:
    """A31. One row: mean over clusters b of the share of their most frequent class a; null with under two of either."""
    c = contingency(rows, a, b)
    each = c.groupBy("b").agg((F.max("n") / F.sum("n")).alias("p"))
    many = c.agg(F.count_distinct("a").alias("ka"))
    return each.agg(F.avg("p").alias("p"), F.count("*").alias("kb")).crossJoin(F.broadcast(many)).select(F.when((F.col("ka") >= 2) & (F.col("kb") >= 2), F.col("p")).alias("purity"))  # one row each


def classification(rows: DataFrame, truth: str, guess: str, labels: tuple[str, ...] = MACROS) -> DataFrame:
    """A28, A29. One row: n, accuracy, macro_f1, balanced_accuracy over rows whose truth and guess are both labels; a label
    without rows counts zero in f1 (over labels that occur) and is left out of the balanced accuracy."""
    c = contingency(rows.where(F.col(truth).isin(*labels) & F.col(guess).isin(*labels)), truth, guess)
    per = c.select(F.explode(F.array(F.struct(F.col("a").alias("l"), F.col("n").alias("t"), F.lit(0).cast("long").alias("g"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("b").alias("l"), F.lit(0).cast("long").alias("t"), F.col("n").alias("g"), F.lit(0).cast("long").alias("h")))).alias("x"))
    s = per.groupBy("x.l").agg(F.sum("x.t").alias("t"), F.sum("x.g").alias("g"), F.sum("x.h").alias("h"))
    return s.agg(F.sum("t").alias("n"), F.try_divide(F.sum("h"), F.sum("t")).alias("accuracy"), F.avg(2 * F.col("h") / (F.col("t") + F.col("g"))).alias("macro_f1"), F.avg(F.when(F.col("t") > 0, F.col("h") / F.col("t"))).alias("balanced_accuracy"))


def transition(rows: DataFrame, a: str, b: str, labels: tuple[str, ...] = MACROS) -> DataFrame:
    """A13. (source, A0, A1, B, C): counts by both labels, all label pairs present, zero where none; one row a label."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "source string")
    c = rows.where(F.col(a).isin(*labels)).groupBy(F.col(a).alias("source")).pivot(b, list(labels)).count()
    return names.join(c, "source", "left").fillna(0)


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """A14. (a, b, n) of label pairs that occur."""
    return contingency(rows, a, b).select(F.col("a").alias(a), F.col("b").alias(b), "n")


def change_rate(rows: DataFrame, a: str, b: str) -> DataFrame:
    """A15. One row: n and the share of rows whose labels differ, null labels as labels of their own."""
    return rows.agg(F.count("*").alias("n"), F.avg((~F.col(a).eqNullSafe(F.col(b))).cast("double")).alias("change_rate"))


def correlation(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A37. (x, y, corr) of each pair of columns in one pass; null where a column is constant."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    one = rows.agg(*[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.nanvl(F.col(f"c{i}"), F.lit(None).cast("double")).alias("corr")) for i, (x, y) in enumerate(pairs)])).alias("t")).select("t.*")


def histogram(rows: DataFrame, value: Column, bins: int = 40, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """A41. (bin from 1, n) of equal bins; the upper end counts to the last; nulls, NaN and values outside don't count."""
    at = F.least(F.floor((value - low) / (high - low) * bins).cast("int") + 1, F.lit(bins))
    return rows.where(value.between(low, high) & ~F.isnan(value)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def silhouette(vectors: DataFrame, label: str, queries: int = 10_000, block: int = 1000) -> DataFrame:
    """A36, O5. One row (n, silhouette): mean over vectors (doc_id, embedding, label) of (b - a) / max(a, b) with plain Euclidean distances.

    The mean is taken over all vectors up to `queries`, else over as many of least hash of doc_id; each is compared with all
    vectors. The queries, bounded by that number, go to the tasks; a pass over the vectors sums their distances to each
    query by label, added up by blocks of queries. A label of one vector gives 0; null with under two labels.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    held = vectors.where(F.col(label).isNotNull() & F.col("embedding").isNotNull())
    sizes = {r[0]: r[1] for r in held.groupBy(label).count().collect()}  # a row a label
    names = sorted(sizes)
    if len(names) < 2:
        return spark.createDataFrame([(0, None)], "n long, silhouette double")
    n = np.array([sizes[x] for x in names], np.float64)
    code = F.array_position(F.array(*map(F.lit, names)), F.col(label)).cast("int") - 1
    rows = held.select(code.alias("k"), "embedding", F.xxhash64("doc_id").alias("h"), "doc_id")
    asked = rows.orderBy("h", "doc_id").limit(queries).select("k", "embedding").collect()  # bounded by queries
    q, qk = np.array([r.embedding for r in asked], np.float64), np.array([r.k for r in asked], np.int64)
    square = (q * q).sum(1)

    def sums(batches):
        total = np.zeros((len(q), len(names)))
        for b in batches:
            k = np.asarray(b.column("k"))
            x = np.asarray(b.column("embedding").flatten(), np.float64).reshape(b.num_rows, -1)
            for i in range(0, len(x), block):
                y = x[i : i + block]
                one = np.zeros((len(y), len(names)))
                one[np.arange(len(y)), k[i : i + block]] = 1
                for j in range(0, len(q), block):
                    far = np.sqrt(np.clip(square[j : j + block, None] + (y * y).sum(1) - 2 * q[j : j + block] @ y.T, 0, None))
                    total[j : j + block] += far @ one
        for j in range(0, len(q), block):
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([total[j : j + block].tobytes()], pa.binary())], ["j", "s"])

    def finish(key, t):
        s = np.sum([np.frombuffer(x).reshape(-1, len(names)) for x in t.column("s").to_pylist()], axis=0)
        at = key[0].as_py()
        k = qk[at : at + len(s)]
        own = np.arange(len(k)), k
        with np.errstate(all="ignore"):
            a = s[own] / (n[k] - 1)
            other = s / n
            other[own] = np.inf
            low = other.min(1)
            v = np.where(n[k] > 1, (low - a) / np.maximum(a, low), 0.0)
        return pa.table({"n": pa.array([len(v)], pa.int64()), "v": pa.array([float(np.nan_to_num(v).sum())])})

    return rows.select("k", "embedding").mapInArrow(sums, "j int, s binary").groupBy("j").applyInArrow(finish, "n long, v double").agg(F.sum("n").alias("n"), (F.sum("v") / F.sum("n")).alias("silhouette"))
