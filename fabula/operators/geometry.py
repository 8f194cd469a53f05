"""How well labels structure a vector space: inertia ratios, effective rank, principal-component energy.

All sums are taken over wide dim_* columns in one aggregation by label (2 D sums, combined on the map side), so that no
vector is exploded and the result has one row a label, whatever the number of vectors.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPS, MACROS
from ..sources.readers import dim_columns, squared_length


def normalised(df: DataFrame) -> DataFrame:
    """P17 on wide columns."""
    length = F.greatest(F.sqrt(squared_length(df)), F.lit(EPS))
    dims = dim_columns(df)
    rest = [c for c in df.columns if c not in dims]
    held = df.select(*rest, *dims, length.alias("_length"))
    return held.select(*rest, *[(F.col(c).cast("double") / F.col("_length")).alias(c) for c in dims])


def label_sums(df: DataFrame, *by: str) -> DataFrame:
    """by, n, s array of sums, q array of sums of squares by dimension."""
    dims = dim_columns(df)
    d = {c: F.col(c).cast("double") for c in dims}
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s_{c}") for c, x in d.items()], F.sum(reduce(lambda a, b: a + b, [x * x for x in d.values()])).alias("q"))
    return out.select(*by, "n", F.array(*[F.col(f"s_{c}") for c in dims]).alias("s"), "q")


def _squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def class_geometry(sums: DataFrame, *by: str) -> DataFrame:
    """A1. (by, n, w, mean): inertia within each label, null for a label of one vector."""
    mean = F.transform("s", lambda x: x / F.col("n"))
    return sums.select(*by, "n", "s", "q", mean.alias("mean")).withColumn("w", F.when(F.col("n") >= 2, F.greatest(F.col("q") / F.col("n") - _squares(F.col("mean")), F.lit(0.0))))


def scatter(n: Column, q: Column, s: Column, centre: Column) -> Column:
    """A2. Mean squared distance to any centre."""
    cross = F.aggregate(F.zip_with(s, centre, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.greatest(q / n - 2 * cross / n + _squares(centre), F.lit(0.0))


def _ratio(t: Column, w: Column) -> Column:
    return F.when(t > EPS, F.least(F.greatest(1 - w / (t + EPS), F.lit(0.0)), F.lit(1.0)))


def eta2(df: DataFrame, label: str = "label", labels: tuple[str, ...] = MACROS) -> DataFrame:
    """A3. One row: n, balanced and weighted T, W, B and ratios, w_ and n_ of each label, labels ignored.

    df: dim_* columns and label. Rows with another label or null are dropped. A label of one vector is ignored in the balanced means
    and in W, but its vector counts in the weighted total; undefined values are null; no rows or one give n 0.
    """
    sums = class_geometry(label_sums(df.where(F.col(label).isin(*labels)), label), label)
    d = len(dim_columns(df))
    rows = sums.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("c"), "n", "w", "mean", "s", "q"))).alias("all"))  # a row a label
    ok = F.filter("all", lambda x: x["n"] >= 2)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    zero = F.array_repeat(F.lit(0.0), d)
    add = lambda xs, get: F.aggregate(xs, F.lit(0.0), lambda a, x: a + get(x))
    base = rows.select("all", ok.alias("ok"), F.size(ok).alias("k"), add(F.col("all"), lambda x: x["n"].cast("double")).alias("n"))
    base = base.select("*", F.transform(F.aggregate("ok", zero, lambda a, x: plus(a, x["mean"])), lambda x: x / F.nullif(F.col("k"), F.lit(0))).alias("mb"), F.transform(F.aggregate("all", zero, lambda a, x: plus(a, x["s"])), lambda x: x / F.nullif(F.col("n"), F.lit(0.0))).alias("mw"))
    some = (F.col("n") >= 2) & (F.col("k") >= 1)
    tb = F.when(some, add(F.col("ok"), lambda x: scatter(x["n"], x["q"], x["s"], F.col("mb"))) / F.nullif(F.col("k"), F.lit(0)))
    wb = F.when(some, add(F.col("ok"), lambda x: x["w"]) / F.nullif(F.col("k"), F.lit(0)))
    tw = F.when(some, F.greatest(add(F.col("all"), lambda x: x["q"]) / F.nullif(F.col("n"), F.lit(0.0)) - _squares(F.col("mw")), F.lit(0.0)))
    ww = F.when(some, add(F.col("ok"), lambda x: x["n"] * x["w"]) / F.nullif(F.col("n"), F.lit(0.0)))
    named = base.select(F.when(some, F.col("n").cast("long")).otherwise(0).alias("n"), tb.alias("T_balanced"), wb.alias("W_balanced"), tw.alias("T_weighted"), ww.alias("W_weighted"), "all", "ok")
    of = lambda c, field: F.get(F.transform(F.filter("all", lambda x: x["c"] == c), lambda x: x[field]), F.lit(0))
    return named.select(
        "n",
        "T_balanced",
        "W_balanced",
        (F.col("T_balanced") - F.col("W_balanced")).alias("B_balanced"),
        _ratio(F.col("T_balanced"), F.col("W_balanced")).alias("eta2_macro_balanced"),
        (100 * _ratio(F.col("T_balanced"), F.col("W_balanced"))).alias("eta2_macro_balanced_perc"),
        "T_weighted",
        "W_weighted",
        (F.col("T_weighted") - F.col("W_weighted")).alias("B_weighted"),
        _ratio(F.col("T_weighted"), F.col("W_weighted")).alias("eta2_weighted"),
        *[of(c, "w").alias(f"W_{c}") for c in labels],
        *[F.coalesce(of(c, "n"), F.lit(0)).alias(f"n_{c}") for c in labels],
        F.concat_ws(",", F.transform(F.filter("all", lambda x: x["n"] == 1), lambda x: x["c"])).alias("macros_ignored"),
    )


def centroids(df: DataFrame, label: str = "label") -> DataFrame:
    """A39. (label, n, vec): the mean vector of each label."""
    return label_sums(df, label).select(label, "n", F.transform("s", lambda x: x / F.col("n")).alias("vec"))


def spectrum(df: DataFrame, *by: str) -> DataFrame:
    """M1, A33. (by, n, rankme, c1, c10) of centred vectors, by group; the whole table for no group.

    The D x D matrix of products is summed in NumPy per task and group, added up once, and its eigenvalues are the squared
    singular values. rankme = exp of the entropy of singular values; c1 and c10 shares of the 1 and 10 largest squared.
    Groups of under two vectors, or of equal vectors, give nulls.
    """
    dims = dim_columns(df)
    d = len(dims)
    keyed = df.select(F.to_json(F.struct(*by)).alias("key") if by else F.lit("").alias("key"), *dims)

    def part(batches):
        held: dict[str, list] = {}
        for b in batches:
            x = np.stack([np.asarray(b.column(c).to_numpy(zero_copy_only=False), np.float64) for c in dims], axis=1)
            keys = np.asarray(b.column("key").to_pylist(), object)
            for k in set(keys):
                y = x[keys == k]
                h = held.setdefault(k, [0, np.zeros(d), np.zeros((d, d))])
                h[0] += len(y)
                h[1] += y.sum(0)
                h[2] += y.T @ y
        for k, (n, s, g) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], ["key", "n", "s", "g"])

    def whole(key, t):
        n = sum(t.column("n").to_pylist())
        s = sum(np.frombuffer(x) for x in t.column("s").to_pylist())
        g = sum(np.frombuffer(x).reshape(d, d) for x in t.column("g").to_pylist())
        out = [None, None, None]
        if n >= 2:
            lam = np.clip(np.linalg.eigvalsh(g - np.outer(s, s) / n)[::-1], 0, None)
            if lam.sum() > EPS:
                lam = lam[: min(n, d)]
                sigma = np.sqrt(lam)
                p = sigma / sigma.sum()
                p = p[p > 0]
                out = [float(np.exp(-(p * np.log(p)).sum())), float(lam[0] / lam.sum()), float(lam[: min(10, n, d)].sum() / lam.sum())]
        return pa.table({"key": pa.array([key[0].as_py()]), "n": pa.array([n], pa.int64()), **{c: pa.array([v], pa.float64()) for c, v in zip(("rankme", "c1", "c10"), out)}})

    res = keyed.mapInArrow(part, "key string, n long, s binary, g binary").groupBy("key").applyInArrow(whole, "key string, n long, rankme double, c1 double, c10 double")
    return res.select(*[F.get_json_object("key", f"$.{c}").alias(c) for c in by], "n", "rankme", "c1", "c10")


def metric_row(df: DataFrame, method: str, corpus: str, label: str = "label") -> DataFrame:
    """A4. The metric row of a method on a corpus."""
    valid = df.where(F.col(label).isin(*MACROS))
    s = spectrum(valid).select(F.col("rankme").alias("rankme_global"), "c1", "c10")
    return eta2(df, label).crossJoin(F.broadcast(s)).select(F.lit(method).alias("method"), F.lit(corpus).alias("corpus"), "*")  # one row each


def projection(df: DataFrame, k: int = 2) -> DataFrame:
    """M27. (doc_id, pc array): the first k principal components of wide vectors."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    dims = dim_columns(df)
    held = VectorAssembler(inputCols=dims, outputCol="_v").transform(df.select("doc_id", *[F.col(c).cast("double").alias(c) for c in dims]))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(held).transform(held).select("doc_id", vector_to_array("_p").alias("pc"))


def davies_bouldin_and_calinski(df: DataFrame, label: str = "label") -> DataFrame:
    """A36. One row (n, k, davies_bouldin, calinski_harabasz) of labelled wide vectors, from one pass of sums and one of
    distances to the own centre. Null with under two labels, or where a value is undefined."""
    sums = class_geometry(label_sums(df.where(F.col(label).isNotNull()), label), label)
    dims = dim_columns(df)
    centres = sums.select(label, "mean")
    far = df.join(F.broadcast(centres), label).select(label, F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(c).cast("double") - F.get("mean", F.lit(i)), F.lit(2.0)) for i, c in enumerate(dims)])).alias("r"))  # centres: a row a label
    spread = far.groupBy(label).agg(F.avg("r").alias("r"))
    one = sums.join(spread, label).select(F.col(label).alias("i"), "mean", "r", "n", "s", "q")
    pair = one.alias("a").join(one.alias("b"), F.col("a.i") != F.col("b.i"))
    gap = F.sqrt(F.aggregate(F.zip_with("a.mean", "b.mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    db = pair.select(F.col("a.i").alias("i"), F.try_divide(F.col("a.r") + F.col("b.r"), gap).alias("v")).groupBy("i").agg(F.max("v").alias("v")).agg(F.avg("v").alias("davies_bouldin"))
    total = one.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("q").alias("q"), F.sum(F.col("n") * F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)).alias("between"), *[F.sum(F.get("s", F.lit(i))).alias(f"t{i}") for i in range(len(dims))])
    middle = reduce(lambda a, b: a + b, [F.col(f"t{i}") * F.col(f"t{i}") for i in range(len(dims))]) / F.col("n")
    within, between = F.col("q") - F.col("between"), F.col("between") - middle
    ch = F.when((F.col("k") >= 2) & (F.col("n") > F.col("k")), F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))))
    return total.select("n", "k", ch.alias("calinski_harabasz")).crossJoin(F.broadcast(db))  # one row each
