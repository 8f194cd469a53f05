"""Latent-topic posteriors from prototypes: cosines, softmaxes, mixtures, entropies, usage, E-step scores, losses.

A prototype table has one row a label or topic (bounded by their number, tens to a few hundred) with a unit vector; it is broadcast.
A vector's scores against all prototypes are one array column, so no (vector, prototype) rows are made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPS, MACROS, argmax, dot, entropy, l2_normalised, softmax

LOG_FLOOR = 1e-8


def prototypes(vectors: DataFrame, label: str) -> DataFrame:
    """(id, vec): normalised mean of the unit vectors (array column embedding) of each label; one partial sum a task and label."""
    import pyarrow as pa

    rows = vectors.where(F.col(label).isNotNull() & F.col("embedding").isNotNull()).select(F.col(label).alias("id"), "embedding")
    kind = dict(rows.dtypes)["id"]

    def part(batches):
        total: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("embedding").flatten(), np.float64).reshape(b.num_rows, -1)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)
            names = b.column("id").dictionary_encode()
            code = np.asarray(names.indices)
            for k, name in enumerate(names.dictionary.to_pylist()):
                mine = x[code == k]
                n, s = total.get(name, (0, 0.0))
                total[name] = (n + len(mine), s + mine.sum(0))
        ids = list(total)
        of = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(ids, of), pa.array([total[i][0] for i in ids], pa.int64()), pa.array([total[i][1].tobytes() for i in ids], pa.binary())], ["id", "n", "s"])

    def whole(key, t):
        m = np.sum([np.frombuffer(x) for x in t.column("s").to_pylist()], axis=0) / sum(t.column("n").to_pylist())
        return pa.table({"id": t.column("id").slice(0, 1), "vec": pa.array([(m / max(float(np.linalg.norm(m)), EPS)).tolist()], pa.list_(pa.float64()))})

    return rows.mapInArrow(part, f"id {kind}, n long, s binary").groupBy("id").applyInArrow(whole, f"id {kind}, vec array<double>")


def matrix(protos: DataFrame) -> tuple[list, np.ndarray]:
    """(ids, unit vectors as columns) of prototypes, a row a label or topic, in the order of id."""
    table = protos.select("id", "vec").orderBy("id").collect()
    p = np.array([r["vec"] for r in table], np.float64).reshape(len(table), -1)
    return [r["id"] for r in table], (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), EPS)).T


def batch_vectors(b) -> np.ndarray:
    return np.asarray(b.column("embedding").flatten(), np.float64).reshape(b.num_rows, -1)


def batch_softmax(x: np.ndarray, p: np.ndarray, temperature: float) -> np.ndarray:
    """Softmax over the columns of p of the cosine of each row of x, divided by the temperature."""
    if not p.shape[1] or not len(x):
        return np.zeros((len(x), p.shape[1]))
    s = x @ p / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS) / temperature
    s = np.exp(s - s.max(1, keepdims=True))
    return s / s.sum(1, keepdims=True)


def list_column(x: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def compatibilities(yz: DataFrame) -> tuple[list, np.ndarray]:
    """(label ids, topics x labels) of p(label | topic), topics in the order of id."""
    rows = yz.select("id", "q", "q_ids").orderBy("id").collect()
    return (rows[0]["q_ids"] if rows else []), np.array([r["q"] for r in rows], np.float64).reshape(len(rows), -1)


def scored(vectors: DataFrame, protos: DataFrame, temperature: float, name: str = "p", yz: DataFrame | None = None) -> DataFrame:
    """M2, M8. vectors with `name`: softmax over prototypes of cosine / temperature, in the order of id; name_ids: the ids.
    With yz (p(label | topic) of the prototypes) also y and y_ids: p(label | x), the mixture.

    The prototypes, a row a label or topic, go to the tasks; a batch of vectors is one matrix product. Rows without vector are left out.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    ids, p = matrix(protos)
    labels, q = ([], None) if yz is None else compatibilities(yz)

    def run(batches):
        for b in batches:
            s = batch_softmax(batch_vectors(b), p, temperature)
            more = [] if q is None else [list_column(s @ q)]
            yield pa.RecordBatch.from_arrays([*b.columns, list_column(s), *more], [*b.schema.names, name, *(["y"] if more else [])])

    schema = StructType([*vectors.schema.fields]).add(name, ArrayType(DoubleType()))
    if yz is not None:
        schema = schema.add("y", ArrayType(DoubleType()))
    out = vectors.where(F.col("embedding").isNotNull()).mapInArrow(run, schema).withColumn(f"{name}_ids", F.array(*map(F.lit, ids)))
    return out if yz is None else out.withColumn("y_ids", F.array(*map(F.lit, labels)))


def topic_labels(topics: DataFrame, labels: DataFrame, temperature: float = 1.0) -> DataFrame:
    """M2. (id, q array over labels): p(label | topic), softmax over labels of their cosine / temperature."""
    return scored(topics.select("id", F.col("vec").alias("embedding")), labels, temperature, "q").select("id", "q", F.col("q_ids"))


def mixture(p: Column, qs: Column) -> Column:
    """p(label | x) = sum over topics of p(topic | x) p(label | topic). qs: array over topics of arrays over labels."""
    weighted = F.zip_with(p, qs, lambda w, q: F.transform(q, lambda x: x * w))
    zero = F.transform(F.get(qs, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(weighted, zero, lambda a, x: F.zip_with(a, x, lambda u, v: u + v))


def with_mixture(zx: DataFrame, yz: DataFrame) -> DataFrame:
    """zx (with p over topics) and y: p(label | x)."""
    t = yz.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "q"))), lambda s: s["q"]).alias("qs"))
    return zx.crossJoin(F.broadcast(t)).withColumn("y", mixture(F.col("p"), F.col("qs"))).drop("qs")  # a single row


def em_score(p_zx: Column, p0: Column, qs: Column) -> Column:
    """M4. Array over topics: exp(ln p(z|x) + sum over labels of p0 ln p(label|z)), both logarithms floored at 1e-8.
    With one-hot p0 this is M3, p(z|x) p(label of x | z)."""
    ln = lambda x: F.ln(F.greatest(x, F.lit(LOG_FLOOR)))
    return F.zip_with(p_zx, qs, lambda p, q: F.exp(ln(p) + F.aggregate(F.zip_with(p0, q, lambda a, b: a * ln(b)), F.lit(0.0), lambda s, x: s + x)))


def usage(assigned: DataFrame, z: str = "z_hat") -> DataFrame:
    """A17. One row: n_active clusters, usage_entropy, max_mass."""
    counts = assigned.where(F.col(z).isNotNull()).groupBy(z).count()
    total = counts.agg(F.sum("count").alias("n"))
    share = F.col("count") / F.col("n")
    return counts.crossJoin(F.broadcast(total)).agg(F.count("*").alias("n_active"), F.sum(-share * F.ln(share)).alias("usage_entropy"), F.max(share).alias("max_mass"))  # a single row


def affiliation(topics: DataFrame, yz: DataFrame, assigned: DataFrame, z: str = "z_hat") -> DataFrame:
    """A18. (z_id, p_A0..p_C, dominant_macro, n_units), topics without units included."""
    counts = assigned.groupBy(F.col(z).alias("z_id")).agg(F.count("*").alias("n_units"))
    cols = [F.coalesce(F.get("q", (F.array_position("q_ids", F.lit(m)) - 1).cast("int")), F.lit(0.0)).alias(f"p_{m}") for m in MACROS]
    return yz.select(F.col("id").alias("z_id"), *cols, F.get("q_ids", argmax(F.col("q"))).alias("dominant_macro")).join(counts, "z_id", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))


def balance_step(scores: np.ndarray, sharpness: float = 25.0, tolerance: float = 0.1, most: int = 1000) -> np.ndarray:
    """M5. Balanced assignment by alternate scaling: the plan of scores**sharpness whose rows weigh 1/n and columns 1/k.

    Strictly positive scores; scaled by each row's largest first, which leaves the plan as it is. Stops when the column
    scaling changes by at most tolerance in sum (looked at every tenth step), or after `most` steps.
    """
    n, k = scores.shape
    p = np.maximum(scores / scores.max(1, keepdims=True), 1e-300).astype(np.float64) ** sharpness
    p = np.maximum(p, 1e-300)
    r = np.full(n, 1.0 / n)
    for step in range(1, most + 1):
        c = (1.0 / k) / (r @ p)
        fresh = (1.0 / n) / (p @ c)
        with np.errstate(divide="ignore", invalid="ignore"):
            moved = np.abs(r / fresh - 1).sum()
        r = fresh
        if step % 10 == 0 and moved <= tolerance:
            break
    return p * r[:, None] * c[None, :]


def balanced_factors(rows: DataFrame, sharpness: float, tolerance: float, most: int) -> tuple[np.ndarray, float]:
    """(logarithms of the column factors, residual) of the balanced plan of rows (s): the residual is the sum over columns of
    how far k times the column's mass is from one.

    Balancing only has k unknowns: they minimise the mean of ln sum_j s_ij^sharpness e^g_j, less the mean of g. Newton steps on
    them, damped where a step would not go down, take a few passes; a pass returns k + k x k numbers a task.
    """
    import pyarrow as pa

    k = rows.select(F.size("s")).first()[0]
    n = rows.count()

    def measured(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def sums(batches):
            value, first, second = 0.0, np.zeros(k), np.zeros((k, k))
            for b in batches:
                x = log_kernel(b, k, sharpness) + g
                top = x.max(1, keepdims=True, initial=-np.inf)
                p = np.exp(x - top)
                total = p.sum(1, keepdims=True)
                value += float((top + np.log(total)).sum())
                p /= total
                first += p.sum(0)
                second += p.T @ p
            yield pa.RecordBatch.from_arrays([pa.array([np.r_[value, first, second.ravel()].tobytes()], pa.binary())], ["m"])

        m = np.sum([np.frombuffer(r.m) for r in rows.select("s").mapInArrow(sums, "m binary").collect()], axis=0) / n
        return m[0] - g.mean(), m[1 : k + 1] - 1 / k, np.diag(m[1 : k + 1]) - m[k + 1 :].reshape(k, k)

    g, damp = np.zeros(k), 1e-3
    value, slope, curve = measured(g)
    for _ in range(most):
        residual = float(np.abs(slope * k).sum())
        if residual <= tolerance:
            break
        step = np.linalg.solve(curve + damp * np.diag(np.diag(curve)) + 1e-9 * np.eye(k), -slope)
        step *= min(1.0, 30.0 / max(np.abs(step).max(), 1e-12))
        trial = measured(g + step)
        if trial[0] <= value + 1e-12:
            g, damp, (value, slope, curve) = g + step, damp / 10, trial
            g -= g.mean()
        else:
            damp = max(damp, 1e-4) * 10
    return g, float(np.abs(slope * k).sum())


def log_kernel(b, k: int, sharpness: float) -> np.ndarray:
    s = np.asarray(b.column("s").flatten(), np.float64).reshape(b.num_rows, k)
    return sharpness * np.log(np.maximum(s / np.maximum(s.max(1, keepdims=True, initial=0), 1e-300), 1e-12))


def sinkhorn(scores: DataFrame, sharpness: float = 25.0, tolerance: float = 0.01, most: int = 100) -> DataFrame:
    """M5, M6. (doc_id, z_hat, mass): balanced hard assignment of scores (doc_id, s array over topics), of any number of rows;
    mass: the topic's share of the row in the plan. Raises if the plan isn't balanced to the tolerance after `most` passes.

    Only the k column factors are held between passes; a row's own factor is derived from them, so that no (row, topic)
    table is shuffled or kept. Scores count as 1e-12 of the row's largest at least.
    """
    import pyarrow as pa

    from ..session import cut

    rows = cut(scores.where(F.size("s") > 0).select("doc_id", "s"))
    if rows.isEmpty():
        return scores.sparkSession.createDataFrame([], "doc_id long, z_hat int, mass double")
    g, residual = balanced_factors(rows, sharpness, tolerance, most)
    if residual > tolerance:
        raise RuntimeError(f"balanced assignment left a residual of {residual:.3g} after {most} passes")
    k = len(g)

    def pick(batches):
        for b in batches:
            x = log_kernel(b, k, sharpness) + g
            p = np.exp(x - x.max(1, keepdims=True, initial=-np.inf))
            p /= p.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p.argmax(1).astype(np.int32)), pa.array(p.max(1, initial=0))], ["doc_id", "z_hat", "mass"])

    return rows.mapInArrow(pick, "doc_id long, z_hat int, mass double")


def initial_topics(df: DataFrame, k: int, mode: str = "p0_block", classes: int = len(MACROS)) -> DataFrame:
    """M7. df with q_init: block (a topic of the label's block, by hash), hash (any topic by hash), argmax (of array s)."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(k)).cast("int")
    if mode == "hash":
        return df.withColumn("q_init", h)
    if mode == "argmax":
        return df.withColumn("q_init", argmax(F.col("s")))
    low = F.floor(F.col("macro_id") * k / classes).cast("int")
    high = F.floor((F.col("macro_id") + 1) * k / classes).cast("int")
    return df.withColumn("q_init", (low + F.pmod(F.xxhash64("doc_id"), F.greatest(high - low, F.lit(1)))).cast("int"))


def prototype_em(vectors: DataFrame, start: DataFrame, steps: int = 5, temperature: float = 0.1, balanced: bool = False) -> DataFrame:
    """M24 in closed form. Prototypes after so many rounds of E (posterior, or balanced assignment) and M (normalised
    weighted means). Gradient training isn't offered; this variant keeps the model's two steps."""
    from ..session import cut

    import pyarrow as pa

    at = cut(start.select("id", "vec").orderBy("id"))
    held = cut(vectors.where(F.col("embedding").isNotNull()).select("doc_id", l2_normalised(F.col("embedding")).alias("embedding")))
    for _ in range(steps):
        ids, p = matrix(at)
        k, d = p.shape[1], p.shape[0]

        def sums(batches, p=p, k=k, d=d):
            total = np.zeros((k, d))
            for b in batches:
                x = batch_vectors(b)
                if balanced:
                    np.add.at(total, np.asarray(b.column("z_hat")), x)
                else:
                    total += batch_softmax(x, p, temperature).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        rows = held
        if balanced:
            rows = held.join(sinkhorn(scored(held, at, temperature).select("doc_id", F.col("p").alias("s"))), "doc_id").select("embedding", "z_hat")
        parts = rows.mapInArrow(sums, "m binary").collect()  # topics x dimensions numbers a task
        total = np.sum([np.frombuffer(r.m).reshape(k, d) for r in parts], axis=0) if parts else np.zeros((k, d))
        length = np.linalg.norm(total, axis=1, keepdims=True)
        fresh = np.where(length > EPS, total / np.maximum(length, EPS), p.T)
        at = at.sparkSession.createDataFrame([(i, v.tolist()) for i, v in zip(ids, fresh)], at.schema)
    return at


def kmeans_topics(vectors: DataFrame, by: str, k: int, seed: int = 42) -> DataFrame:
    """M12, M13. (doc_id, by, cluster, distance): k-means within each label, by label in turn (there are few)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    out = None
    for (m,) in vectors.select(by).where(F.col(by).isNotNull()).distinct().orderBy(by).collect():  # a row a label
        part = vectors.where(F.col(by) == m).withColumn("features", array_to_vector("embedding"))
        model = KMeans(k=k, seed=seed, initMode="k-means||").fit(part)
        centres = part.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
        got = model.transform(part).withColumnRenamed("prediction", "cluster").join(F.broadcast(centres), "cluster")  # k rows
        gap = F.sqrt(F.aggregate(F.zip_with("embedding", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        got = got.select("doc_id", F.col(by), "cluster", gap.alias("distance"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no labelled vectors")
    return out


# losses, given fixed prototypes -----------------------------------------------------------------------------------------


def cross_entropy(p: Column, at: Column) -> Column:
    return -F.ln(F.greatest(F.get(p, at), F.lit(1e-12)))


def soft_cross_entropy(target: Column, p: Column, floor: float = 1e-12) -> Column:
    return -F.aggregate(F.zip_with(target, p, lambda t, x: t * F.ln(F.greatest(x, F.lit(floor)))), F.lit(0.0), lambda s, x: s + x)


def kl(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: a * (F.ln(F.greatest(a, F.lit(EPS))) - F.ln(F.greatest(b, F.lit(EPS))))), F.lit(0.0), lambda s, x: s + x)


def distillation(teacher: Column, student: Column, temperature: float) -> Column:
    """T^2 KL(softmax(teacher/T) || softmax(student/T)) of logits."""
    soft = lambda v: softmax(F.transform(v, lambda x: x / temperature))
    return temperature**2 * kl(soft(teacher), soft(student))


def assignment_losses(zx: DataFrame, yz: DataFrame, macro: str = "macro_id") -> DataFrame:
    """M20. One row: ls1 (latent cross-entropy of the best topic), ls2 (its label compatibility), mean entropy of p(z|x)."""
    t = yz.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "q"))), lambda s: s["q"]).alias("qs"))
    rows = zx.where(F.col(macro).isNotNull()).crossJoin(F.broadcast(t)).withColumn("z", argmax(F.col("p")))  # a single row
    return rows.agg(F.avg(cross_entropy(F.col("p"), F.col("z"))).alias("ls1"), F.avg(-F.ln(F.greatest(F.get(F.get("qs", F.col("z")), F.col(macro)), F.lit(1e-12)))).alias("ls2"), F.avg(entropy(F.col("p"))).alias("mean_entropy"))


def transfer_losses(scored_rows: DataFrame, weights: str = "max") -> DataFrame:
    """M21. One row: em_z, em_yz, em, macro, balance of rows (q, zx, yz_log array over topics, p0, pt).

    q: soft or one-hot assignment; yz_log: sum over labels of p0 ln p(label|z). weights of the macro term: max p0, threshold
    (a quarter below 0.5) or none. balance: KL(uniform || mean p(z|x)).
    """
    w = {"max": F.array_max("p0"), "threshold": F.when(F.array_max("p0") < 0.5, 0.25).otherwise(1.0) * F.array_max("p0"), "none": F.lit(1.0)}[weights]
    inner = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = scored_rows.select("zx", F.lit(1).alias("one"), soft_cross_entropy(F.col("q"), F.col("zx"), LOG_FLOOR).alias("a"), (-inner(F.col("q"), F.col("yz_log"))).alias("b"), (w * soft_cross_entropy(F.col("p0"), F.col("pt"), LOG_FLOOR)).alias("m"), w.alias("w"))
    means = rows.select(F.posexplode("zx").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x"))
    balance = means.agg((F.avg(-F.ln(F.greatest(F.col("x"), F.lit(EPS)))) - F.ln(F.count("*"))).alias("balance"))
    return rows.agg(F.avg("a").alias("em_z"), F.avg("b").alias("em_yz"), (F.avg("a") + F.avg("b")).alias("em"), F.try_divide(F.sum("m"), F.sum("w")).alias("macro")).crossJoin(F.broadcast(balance))  # one row each


def transfer_sums(vectors: DataFrame, topics: DataFrame, labels: DataFrame, yz: DataFrame, temperature: float = 0.1, weights: str = "max") -> DataFrame:
    """M21. The row of `transfer_losses` with one-hot assignments to each vector's best topic, from the vectors themselves: all
    posteriors are matrix products of an Arrow batch, and a task returns sums only. ln p(label | topic) is a constant matrix."""
    import pyarrow as pa

    (_, z), (_, y), (_, q) = matrix(topics), matrix(labels), compatibilities(yz)
    k = z.shape[1]
    ln_q = np.log(np.maximum(q, LOG_FLOOR))

    def sums(batches):
        total = np.zeros(5 + k)
        for b in batches:
            x = batch_vectors(b)
            if not len(x):
                continue
            p, p0 = batch_softmax(x, z, temperature), batch_softmax(x, y, temperature)
            best = np.round(p, 9).argmax(1)
            at = np.arange(len(x))
            top = p0.max(1)
            w = {"max": top, "threshold": np.where(top < 0.5, 0.25, 1.0) * top, "none": np.ones(len(x))}[weights]
            macro = -(p0 * np.log(np.maximum(p @ q, LOG_FLOOR))).sum(1)
            total += np.r_[len(x), -np.log(np.maximum(p[at, best], LOG_FLOOR)).sum(), -(p0 @ ln_q.T)[at, best].sum(), (w * macro).sum(), w.sum(), p.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    got = vectors.where(F.col("embedding").isNotNull()).select("embedding").mapInArrow(sums, "m binary").collect()  # 5 + topics numbers a task
    t = np.sum([np.frombuffer(r.m) for r in got], axis=0) if got else np.zeros(5 + k)
    n = t[0]
    schema = "em_z double, em_yz double, em double, macro double, balance double"
    if n == 0 or k == 0:
        return vectors.sparkSession.createDataFrame([(None,) * 5], schema)
    balance = float(-np.log(np.maximum(t[5:] / n, EPS)).mean() - np.log(k))
    return vectors.sparkSession.createDataFrame([(float(t[1] / n), float(t[2] / n), float((t[1] + t[2]) / n), float(t[3] / t[4]), balance)], schema)


def macro_loss(zx: DataFrame, macro: str = "macro_id") -> DataFrame:
    """M20. One row, ls3: label cross-entropy of the mixture y of rows with a known label."""
    return zx.where(F.col(macro).isNotNull()).agg(F.avg(cross_entropy(F.col("y"), F.col(macro))).alias("ls3"))


def anchor_loss(source: DataFrame, target: DataFrame) -> DataFrame:
    """L_anchor: mean squared distance of normalised anchors by id."""
    j = source.select("id", l2_normalised(F.col("vec")).alias("a")).join(target.select("id", l2_normalised(F.col("vec")).alias("b")), "id")
    return j.agg(F.avg(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)).alias("anchor"))


def diversity_loss(topics: DataFrame, temperature: float = 1.0) -> DataFrame:
    """L_div: mean over pairs of different topics (tens to hundreds) of exp(cosine / temperature)."""
    u = topics.select("id", l2_normalised(F.col("vec")).alias("v"))
    return u.alias("a").join(F.broadcast(u).alias("b"), F.col("a.id") != F.col("b.id")).agg(F.avg(F.exp(dot(F.col("a.v"), F.col("b.v")) / temperature)).alias("diversity"))
