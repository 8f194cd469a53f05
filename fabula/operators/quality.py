"""Quality of topics: diversity, redundancy, overlap of words, coverage, coherence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from ..functions.scalars import outlier_topic


def diversity(topics: DataFrame, k: int) -> DataFrame:
    """A25. One row (topic_diversity, redundancy) of topics (id, words array): distinct words by topics x k, also where a
    topic has fewer words. Null without topics."""
    n = topics.agg(F.count("*").alias("n"))
    d = topics.select(F.explode_outer(F.slice("words", 1, k)).alias("w")).agg(F.count_distinct("w").alias("d"))
    v = F.try_divide(F.col("d"), F.col("n") * max(1, k))
    return n.crossJoin(F.broadcast(d)).select(v.alias("topic_diversity"), (1 - v).alias("redundancy"))  # one row each


def jaccard(topics: DataFrame) -> DataFrame:
    """J9, A26. (a, b, jaccard) of the word lists of all pairs of topics; tens to hundreds of topics of one model."""
    t = topics.select("id", F.array_distinct("words").alias("w"))
    both = t.alias("x").join(F.broadcast(t).alias("y"), F.col("x.id") < F.col("y.id"))
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.coalesce(F.try_divide(F.size(F.array_intersect("x.w", "y.w")), F.size(F.array_union("x.w", "y.w"))), F.lit(0.0)).alias("jaccard"))


def quality_row(topics: DataFrame, n_docs: int | None, k: int = 10, least: int = 0) -> DataFrame:
    """A23 to A27, P13, P14. One row: n_topics, n_valid, coverage, diversity, redundancy, mean Jaccard, mean and median size.

    topics: id, words array, n_docs. Outlier topics count in none of it; coverage is over topics of any size, the rest over
    topics of at least `least` documents.
    """
    real = topics.where(~outlier_topic(F.col("id")))
    valid = real.where(F.col("n_docs") >= least)
    whole = real.agg(F.count("*").alias("n_topics"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("in_topics"))
    sizes = valid.agg(F.count("*").alias("n_valid_topics"), F.avg("n_docs").alias("mean_topic_size"), F.median("n_docs").alias("median_topic_size"))
    overlap = jaccard(valid).agg(F.avg("jaccard").alias("mean_pairwise_jaccard"))
    out = whole
    for one in (sizes, diversity(valid, k), overlap):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out.select("n_topics", "n_valid_topics", F.try_divide(F.col("in_topics"), F.lit(n_docs)).alias("coverage"), "topic_diversity", "redundancy", "mean_pairwise_jaccard", "mean_topic_size", "median_topic_size")


def cooccurrence(docs: DataFrame, words: list[str], size: int, chunk: int = 20_000) -> tuple[int, np.ndarray]:
    """(windows, counts): in how many runs of `size` tokens of a sentence (one run if it is shorter) each two listed words
    stand, on the diagonal each word alone. docs: doc_id, sentence.

    Sentences are split once; of a batch only the places of listed words are kept, and its windows x words table of zeros and
    ones, chunk by chunk, times itself gives the counts. Listed words are the topics' first words, a few hundred.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    v = len(words)
    listed = pa.array(words, pa.string())
    toks = docs.where("sentence is not null").select(T.tokens(T.clean(F.col("sentence"))).alias("t")).where("size(t) > 0")

    def count(batches):
        total, n = np.zeros((v, v)), 0
        for b in batches:
            lists = b.column("t")
            length = np.diff(np.asarray(lists.offsets))
            runs = np.maximum(length - size + 1, 1)
            start = np.cumsum(runs) - runs
            n += int(runs.sum())
            word = np.asarray(pc.index_in(lists.flatten(), value_set=listed).fill_null(-1))
            at = np.flatnonzero(word >= 0)
            first = np.cumsum(length) - length
            doc = np.searchsorted(first, at, "right") - 1
            place = at - first[doc]
            low = np.maximum(place - size + 1, 0)
            many = np.minimum(place, runs[doc] - 1) - low + 1
            window = np.repeat(start[doc] + low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            column = np.repeat(word[at], many)
            order = np.argsort(window, kind="stable")
            window, column = window[order], column[order]
            for lo in range(0, int(runs.sum()), chunk):
                p, q = np.searchsorted(window, [lo, lo + chunk])
                if q > p:
                    table = np.zeros((chunk, v), np.float32)
                    table[window[p:q] - lo, column[p:q]] = 1
                    total += table.T @ table
        for lo in range(0, v, 64):
            yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([n], pa.int64()), pa.array([total[lo : lo + 64].tobytes()], pa.binary())], ["part", "n", "counts"])

    def whole(key, t):
        s = np.sum([np.frombuffer(x) for x in t.column("counts").to_pylist()], axis=0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "counts": pa.array([s.tobytes()], pa.binary())})

    schema = "part int, n long, counts binary"
    got = sorted(toks.mapInArrow(count, schema).groupBy("part").applyInArrow(whole, schema).collect(), key=lambda r: r.part)  # words x words numbers
    return (got[0].n if got else 0), np.concatenate([np.frombuffer(r.counts).reshape(-1, v) for r in got]) if got else np.zeros((v, v))


def _listed(topics: DataFrame, k: int) -> tuple[list, list[str]]:
    """The topics with their first k words, and all these words."""
    rows = topics.select("id", F.slice("words", 1, k).alias("w")).orderBy("id").collect()  # a row a topic
    return rows, sorted({w for r in rows for w in r.w or []})


def npmi(docs: DataFrame, topics: DataFrame, k: int = 10, size: int = 10) -> DataFrame:
    """M11. (id, npmi): mean normalised pointwise mutual information of the pairs of a topic's first k words over sliding
    windows; pairs that never meet count -1. docs: doc_id, sentence; topics: id, words array. No row for under two words."""
    rows, words = _listed(topics, k)
    n, counts = cooccurrence(docs, words, size)
    place = {w: i for i, w in enumerate(words)}
    out = []
    for r in rows:
        at = np.array([place[w] for w in r.w or []], np.int64)
        i, j = np.triu_indices(len(at), 1)
        if not len(i):
            continue
        c = np.where(at[i] == at[j], 0, counts[at[i], at[j]])
        with np.errstate(divide="ignore", invalid="ignore"):
            v = np.log(c * n / (counts[at[i], at[i]] * counts[at[j], at[j]])) / -np.log(c / n)
        out.append((r.id, float(np.where(c == 0, -1.0, np.where(c == n, 1.0, v)).mean())))
    return topics.sparkSession.createDataFrame(out, StructType([topics.schema["id"], StructField("npmi", DoubleType())]))


def context_coherence(docs: DataFrame, topics: DataFrame, k: int = 10, size: int = 110) -> DataFrame:
    """M11. (id, cv): mean cosine of each word's vector of NPMI values against the topic's words with the topic's total
    vector, over windows of 110 tokens (the published C_v measure). Words without a window have zeros; null if all have."""
    rows, words = _listed(topics, k)
    n, counts = cooccurrence(docs, words, size)
    place = {w: i for i, w in enumerate(words)}
    out = []
    for r in rows:
        at = np.array([place[w] for w in dict.fromkeys(r.w or [])], np.int64)
        if not len(at):
            continue
        alone = np.diag(counts)[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = counts[np.ix_(at, at)] / n + 1e-12
            v = np.log(p / np.outer(alone / n, alone / n)) / -np.log(p)
        v = np.where((alone[:, None] == 0) | (alone[None] == 0) | ~np.isfinite(v), 0.0, v)
        total = v.sum(0)
        length = np.linalg.norm(v, axis=1) * np.linalg.norm(total)
        cos = (v @ total)[length > 0] / length[length > 0]
        out.append((r.id, float(cos.mean()) if len(cos) else None))
    return topics.sparkSession.createDataFrame(out, StructType([topics.schema["id"], StructField("cv", DoubleType())]))


def macro_quality(topics: DataFrame, docs_by_macro: DataFrame, k: int = 10) -> DataFrame:
    """A27. (macro, n_topics, n_docs_in_topics, coverage, topic_diversity) by the topics' label; coverage may exceed one where a
    topic's label differs from its documents'. topics: id, words, n_docs, macro; docs_by_macro: macro, n."""
    real = topics.where(~outlier_topic(F.col("id")))
    words = real.select("macro", F.explode_outer(F.slice("words", 1, k)).alias("w")).groupBy("macro").agg(F.count_distinct("w").alias("d"))
    base = real.groupBy("macro").agg(F.count("*").alias("n_topics"), F.sum("n_docs").alias("n_docs_in_topics"))
    return base.join(words, "macro").join(docs_by_macro, "macro", "left").select("macro", "n_topics", "n_docs_in_topics", F.try_divide(F.col("n_docs_in_topics"), F.col("n")).alias("coverage"), (F.col("d") / (F.col("n_topics") * max(1, k))).alias("topic_diversity"))
