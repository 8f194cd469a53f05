"""Prediction exports: derived columns, label shares, themes, aligned tables of topics; projections of vectors and their metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions.scalars import MACROS, argmax
from . import geometry
from .posterior import batch_vectors, list_column

SHARES = [f"p_{m}_given_z" for m in MACROS]
#: Other names of the distances and of the metrics' older columns.
DISTANCES = {"": "euclidean", "euclidean": "euclidean", "eucledian": "euclidean", "l2": "euclidean", "cosine": "cosine"}
METRICS = {"delta_macro_pct": "eta2_macro_balanced_perc", "rankme": "rankme_global"}


def distance_name(name: str | None) -> str:
    """H21. The name of a distance, in any case and with its known misspelling; an error for others."""
    key = (name or "").strip().lower()
    if key not in DISTANCES:
        raise ValueError(f"unknown distance {name!r}")
    return DISTANCES[key]


def metric_name(c: Column) -> Column:
    """H21. A metric's present name."""
    table = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.lower(F.trim(c)))


def aligned(rows: DataFrame, matrix: DataFrame, name: str) -> DataFrame:
    """J3. rows with the array column p of matrix (doc_id, p) as `name`; an error unless both have the same doc_ids, once each.

    One full join tells: both sides are counted in the same pass.
    """
    one = rows.join(matrix.select("doc_id", F.col("p").alias(name), F.lit(1).alias("_m")), "doc_id", "left")
    counts = rows.select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("b")).union(matrix.select("doc_id", F.lit(0), F.lit(1))).groupBy("doc_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    if bad := counts.where("a <> 1 or b <> 1").count():
        raise ValueError(f"{name}: {bad} doc_ids are not in both tables once")
    return one.drop("_m")


def derived(rows: DataFrame, p0: DataFrame | None = None, pt: DataFrame | None = None, pz: DataFrame | None = None, yz: DataFrame | None = None) -> DataFrame:
    """S9. rows with the columns that they lack and matrices (doc_id, p array) can give: p0_<label>, pt_<label>, p0_macro_id and
    name, pt_macro_id and name, z_hat, z_confidence; with yz (z_id, q array over labels) z_dominant_macro and p_<label>_given_z.
    A column that is there stays as it is; ties go to the first."""
    out = rows
    names = F.array(*map(F.lit, MACROS))
    for name, matrix in (("p0", p0), ("pt", pt)):
        if matrix is None:
            continue
        out = aligned(out, matrix, "_p")
        more = {f"{name}_{m}": F.get("_p", F.lit(i)) for i, m in enumerate(MACROS)}
        if f"{name}_macro_name" not in rows.columns:
            more |= {f"{name}_macro_id": argmax(F.col("_p")), f"{name}_macro_name": F.get(names, argmax(F.col("_p")))}
        out = out.withColumns({k: v for k, v in more.items() if k not in rows.columns}).drop("_p")
    if pz is not None:
        more = {"z_hat": argmax(F.col("_p")), "z_confidence": F.array_max("_p")}
        out = aligned(out, pz, "_p").withColumns({k: v for k, v in more.items() if k not in rows.columns}).drop("_p")
    return out if yz is None else label_shares(out, yz)


def label_shares(rows: DataFrame, yz: DataFrame) -> DataFrame:
    """P24. rows with p_<label>_given_z and z_dominant_macro of their topic z_hat, where they lack them; null for topics without."""
    q = yz.select(F.col("z_id").alias("z_hat"), F.col("q").alias("_q"))
    more = {c: F.get("_q", F.lit(i)) for i, c in enumerate(SHARES)} | {"z_dominant_macro": F.get(F.array(*map(F.lit, MACROS)), argmax(F.col("_q")))}
    return rows.join(F.broadcast(q), "z_hat", "left").withColumns({k: v for k, v in more.items() if k not in rows.columns}).drop("_q")  # a row a topic


def with_themes(topics: DataFrame, themes: DataFrame, default: str = "-") -> DataFrame:
    """J5, J6. topics with the summary of their theme by z_id, the default where there is none."""
    return topics.join(themes.select("z_id", "theme_summary"), "z_id", "left").withColumn("theme_summary", F.coalesce("theme_summary", F.lit(default)))


def macro_counts(topics: DataFrame) -> DataFrame:
    """A12. One row a method: the number of its topics of each macro, zero for none."""
    return topics.groupBy("method").pivot("macro", list(MACROS)).count().fillna(0, list(MACROS))


def qualitative(topics: DataFrame) -> DataFrame:
    """M17. (macro, method, place, topic_id, n_docs, top_words, top_sentence_1..3): topics by macro and method, largest first
    (ties by id); sentences are split at ||, blank ones left out, and missing ones are empty."""
    from pyspark.sql import Window

    from ..functions.text import packed_sentences

    w = Window.partitionBy("macro", "method").orderBy(F.desc("n_docs"), "topic_id")
    s = packed_sentences(F.col("top_sentences"), 3)
    rows = topics.where(F.col("macro").isin(*MACROS)).withColumn("place", F.row_number().over(w)).withColumn("_s", s)
    return rows.select("macro", "method", "place", "topic_id", "n_docs", "top_words", *[F.coalesce(F.get("_s", F.lit(i)), F.lit("")).alias(f"top_sentence_{i + 1}") for i in range(3)])


def test_metrics(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """P21. fold_id and the metrics that folds have with the prefix test_, without it."""
    return folds.select("fold_id", *[F.col(f"test_{m}").alias(m) for m in metrics if f"test_{m}" in folds.columns])


def val_columns(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """P22. The metrics with the prefix val_; null where rows lack one."""
    return rows.select(*[c for c in rows.columns if c not in metrics], *[(F.col(m) if m in rows.columns else F.lit(None).cast("double")).alias(f"val_{m}") for m in metrics])


def projected(vectors: DataFrame, kind: str = "identity", weights: list[tuple[np.ndarray, np.ndarray]] = (), name: str = "embedding") -> DataFrame:
    """M23. vectors with their embedding through given weights (matrix rows are outputs, then a bias): identity, linear (one
    layer) or mlp (two, the first rectified). A batch is one matrix product a layer; the weights go to the tasks."""
    if kind not in ("identity", "linear", "mlp"):
        raise ValueError(f"unknown projection {kind!r}")
    if len(weights) != {"identity": 0, "linear": 1, "mlp": 2}[kind]:
        raise ValueError(f"{kind} does not take {len(weights)} layers")
    if kind == "identity":
        return vectors
    layers = [(np.asarray(w, np.float64), np.asarray(b, np.float64)) for w, b in weights]

    def run(batches):
        for b in batches:
            x = batch_vectors(b)
            for i, (w, bias) in enumerate(layers):
                x = x.reshape(-1, w.shape[1]) @ w.T + bias
                x = np.maximum(x, 0) if i < len(layers) - 1 else x
            cols = [list_column(x) if c == "embedding" else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays(cols, [name if c == "embedding" else c for c in b.schema.names])

    schema = StructType()
    for f in vectors.schema.fields:
        schema = schema.add(name, ArrayType(DoubleType())) if f.name == "embedding" else schema.add(f)
    return vectors.where(F.col("embedding").isNotNull()).mapInArrow(run, schema)


def mean_pool(tokens: Column, mask: Column, d: int) -> Column:
    """M23. Mean of the token vectors whose mask is one; zero if none is."""
    total = F.aggregate(F.arrays_zip(tokens.alias("v"), mask.alias("m")), F.array_repeat(F.lit(0.0), d), lambda s, t: F.zip_with(s, t["v"], lambda a, x: a + x * t["m"]))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(total, lambda x: x / n)


def cls_pool(tokens: Column) -> Column:
    """M23. The first token's vector."""
    return F.get(tokens, F.lit(0))


def projected_metrics(vectors: DataFrame, d: int, method: str, corpus: str, kind: str = "identity", weights=(), label: str = "label") -> DataFrame:
    """M28. The metric row of a corpus (label, embedding array) after a projection to d dimensions."""
    out = projected(vectors, kind, list(weights))
    wide = out.select(F.col(label).alias("label"), *[F.get("embedding", F.lit(i)).alias(f"dim_{i + 1}") for i in range(d)])
    return geometry.metric_row(wide, method, corpus)
