"""Sentence vectors from token vectors of the whole text: windows, overlap of spans and tokens, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_offsets(c: Column) -> Column:
    """Array of (start, end) of the runs without blanks, from 0: the offsets of a blank tokenizer."""
    parts = F.regexp_extract_all(c, F.lit(r"\S+|\s+"), F.lit(0))
    at = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found")), lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.when(p.rlike(r"^\S"), F.concat(s["found"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(p)).alias("end"))))).otherwise(s["found"]).alias("found")))
    return at["found"]


def span_tokens(spans: DataFrame, tokens: DataFrame, cell: int = 64) -> DataFrame:
    """J12. (doc_id, span, token): tokens (x, y) that overlap spans (a, b), x < b and y > a, within a text.

    A range join: both sides go to cells of `cell` characters, so that a text of any length is an equi-join on (doc_id,
    cell); a pair that meets in several cells is kept in the first only.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(F.greatest(b - 1, a) / cell)))
    s = spans.where("b > a").select("doc_id", "span", "a", "b", cells(F.col("a"), F.col("b")).alias("cell"))
    t = tokens.where("y > x").select("doc_id", "token", "x", "y", cells(F.col("x"), F.col("y")).alias("cell"))
    j = s.join(t, ["doc_id", "cell"]).where("x < b and y > a")
    return j.where(F.col("cell") == F.greatest(F.floor(F.col("a") / cell), F.floor(F.col("x") / cell))).select("doc_id", "span", "token")


def window_bounds(n: Column, length: int, overlap: int) -> Column:
    """M26. Array of (start, end) of windows over n tokens: each next starts `overlap` before the last one's end."""
    step = length - overlap
    count = F.when(n <= length, F.lit(1)).otherwise(F.ceil((n - length) / step).cast("int") + 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).cast("int").alias("start"), F.least(i * step + length, n).cast("int").alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def coverage(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """M26. (doc_id, n_sentences, n_embedded, coverage_sentences, avg_tokens_per_sentence) of spans that got tokens."""
    got = pairs.groupBy("doc_id", "span").agg(F.count("*").alias("n"))
    j = spans.select("doc_id", "span").join(got, ["doc_id", "span"], "left")
    return j.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count("n").alias("n_embedded"), (F.count("n") / F.count("*")).alias("coverage_sentences"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_tokens_per_sentence"))


def span_means(pairs: DataFrame, token_vectors: DataFrame, d: int) -> DataFrame:
    """M26. (doc_id, span, embedding): mean of the token vectors (doc_id, token, v array) of each span, length one."""
    from ..functions.scalars import l2_normalised

    m = pairs.join(token_vectors, ["doc_id", "token"]).groupBy("doc_id", "span").agg(*[F.avg(F.get("v", F.lit(i))).alias(f"x{i}") for i in range(d)])
    return m.select("doc_id", "span", l2_normalised(F.array(*[F.col(f"x{i}") for i in range(d)])).alias("embedding"))
