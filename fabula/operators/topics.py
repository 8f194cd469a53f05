"""Words and sentences of topics: class-based TF-IDF, TF-IDF, representative sentences, theme tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def term_counts(docs: DataFrame, topic: str, least: int = 2, max_df: float = 0.95) -> DataFrame:
    """(topic, term, tf, df): terms of a topic's sentences, with those in more than max_df of its sentences left out.

    docs: topic, doc_id, sentence. A topic of one sentence has none, as every term is in all its sentences.
    """
    rows = docs.where(F.col(topic).isNotNull() & F.col("sentence").isNotNull()).select(topic, "doc_id", F.explode(T.tokens(F.col("sentence"), least)).alias("term"))
    per_doc = rows.groupBy(topic, "doc_id", "term").agg(F.count("*").alias("n"))
    terms = per_doc.groupBy(topic, "term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    sizes = docs.where(F.col(topic).isNotNull() & F.col("sentence").isNotNull()).groupBy(topic).agg(F.count("*").alias("n_docs"))
    return terms.join(sizes, topic).where(F.col("df") <= F.col("n_docs") * max_df).drop("n_docs")


def class_tfidf(terms: DataFrame, topic: str, separate: bool = True) -> DataFrame:
    """M9. (topic, term, score): tf share times ln(1 + T / df), T and df over topics. separate: each topic by itself, so
    that T and df are 1 and the order is that of plain counts."""
    share = F.col("tf") / (F.sum("tf").over(Window.partitionBy(topic)) + 1e-12)
    if separate:
        return terms.select(topic, "term", (share * F.ln(F.lit(1 + 1 / (1 + 1e-12)))).alias("score"))
    n = terms.select(topic).distinct().agg(F.count("*").alias("n_topics"))
    df = terms.groupBy("term").agg(F.count("*").alias("df_topics"))
    return terms.withColumn("share", share).join(df, "term").crossJoin(F.broadcast(n)).select(topic, "term", (F.col("share") * F.ln(1 + F.col("n_topics") / (F.col("df_topics") + 1e-12))).alias("score"))  # a single row


def tfidf(docs: DataFrame, topic: str, max_features: int = 5000) -> DataFrame:
    """M10. (topic, term, score): sums over a topic's documents of length-normalised tf (ln((1+n)/(1+df)) + 1), of the
    max_features most frequent terms of each topic (ties by term)."""
    rows = docs.where(F.col(topic).isNotNull() & F.col("sentence").isNotNull()).select(topic, "doc_id", F.explode(T.tokens(T.clean_spaced(F.col("sentence")))).alias("term"))
    per_doc = rows.groupBy(topic, "doc_id", "term").agg(F.count("*").alias("tf"))
    w = Window.partitionBy(topic).orderBy(F.desc("all"), "term")
    vocabulary = per_doc.groupBy(topic, "term").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_features).drop("r", "all")
    sizes = docs.where(F.col(topic).isNotNull() & F.col("sentence").isNotNull()).groupBy(topic).agg(F.count("*").alias("n"))
    weighted = per_doc.join(vocabulary, [topic, "term"]).join(F.broadcast(sizes), topic).withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # sizes: a row a topic
    length = weighted.groupBy(topic, "doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return weighted.join(length, [topic, "doc_id"]).groupBy(topic, "term").agg(F.sum(F.col("w") / F.col("len")).alias("score"))


def top_terms(scores: DataFrame, topic: str, k: int = 10) -> DataFrame:
    """W3. (topic, term, score, place): the k terms of highest positive score, then by term. Scores are compared to nine places."""
    w = Window.partitionBy(topic).orderBy(F.desc(F.round("score", 9)), "term")
    return scores.where("score > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_words(scores: DataFrame, topic: str, k: int = 10) -> DataFrame:
    """(topic, top_words array), in order."""
    return top_terms(scores, topic, k).groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]).alias("top_words"))  # k entries a topic


def top_rows(rows: DataFrame, topic: str, order: list[Column], k: int) -> DataFrame:
    """W1, W2, W4, W7. The first k rows of each topic in a total order. A partial top k by hash of the rows comes first,
    so that a topic of any size sends k rows a slice."""
    slices = Window.partitionBy(topic, F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    some = rows.where(F.col(topic).isNotNull()).withColumn("_r", F.row_number().over(slices)).where(F.col("_r") <= k).drop("_r")
    return some.withColumn("place", F.row_number().over(Window.partitionBy(topic).orderBy(*order))).where(F.col("place") <= k)


def nearest_sentences(vectors: DataFrame, topic: str, k: int = 5) -> DataFrame:
    """W1. The k rows nearest (L2) to their topic's mean vector; vectors: doc_id, topic, dim_*."""
    from ..sources.readers import dim_columns
    from .geometry import centroids

    dims = dim_columns(vectors)
    mean = centroids(vectors.where(F.col(topic).isNotNull()), topic).select(topic, "vec")
    far = F.sqrt(sum((F.pow(F.col(c).cast("double") - F.get("vec", F.lit(i)), F.lit(2.0)) for i, c in enumerate(dims)), F.lit(0.0)))
    rows = vectors.join(F.broadcast(mean), topic).select("doc_id", topic, F.round(far, 6).alias("distance"))  # a row a topic
    return top_rows(rows, topic, [F.asc("distance"), F.asc("doc_id")], k)


def themes(units: DataFrame, topic: str, scores: DataFrame, sentences: DataFrame, label: str = "pred_label", all_topics: DataFrame | None = None) -> DataFrame:
    """M15, M16. (topic, dominant_macro, n_units, top_words, top_sentences): lists joined by a blank and by ||.

    sentences: (topic, place, sentence). Topics of all_topics without units stay, with n_units 0. The dominant label is
    the most frequent, ties by label.
    """
    counts = units.where(F.col(topic).isNotNull()).groupBy(topic, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(topic).orderBy(F.desc("n"), F.asc_nulls_last(label))
    dominant = counts.withColumn("r", F.row_number().over(w)).groupBy(topic).agg(F.max(F.when(F.col("r") == 1, F.col(label))).alias("dominant_macro"), F.sum("n").alias("n_units"))
    words = top_words(scores, topic).select(topic, F.concat_ws(" ", "top_words").alias("top_words"))
    packed = sentences.groupBy(topic).agg(F.concat_ws(" || ", F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda s: s["sentence"])).alias("top_sentences"))
    base = all_topics.select(topic).distinct().join(dominant, topic, "left") if all_topics is not None else dominant
    return base.join(words, topic, "left").join(packed, topic, "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))


def themes_by_macro(table: DataFrame, topic: str, k: int = 5) -> DataFrame:
    """A19. (dominant_macro, n_topics, n_units, words): words of each label's k largest topics joined by |."""
    w = Window.partitionBy("dominant_macro").orderBy(F.desc("n_units"), topic)
    ranked = table.where("dominant_macro is not null").withColumn("r", F.row_number().over(w))
    return ranked.groupBy("dominant_macro").agg(F.count("*").alias("n_topics"), F.sum("n_units").alias("n_units"), F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.struct("r", F.coalesce("top_words", F.lit("")).alias("t"))))), lambda s: s["t"])).alias("words"))


def top_values(rows: DataFrame, topic: str, value: str, k: int = 5) -> DataFrame:
    """A21. (topic, values): the k most frequent values as name:count joined by |; nulls don't count."""
    w = Window.partitionBy(topic).orderBy(F.desc("n"), value)
    c = rows.where(F.col(topic).isNotNull() & F.col(value).isNotNull()).groupBy(topic, value).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return c.groupBy(topic).agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", F.col(value), F.col("n").cast("string")).alias("t")))), lambda s: s["t"])).alias("values"))
