"""Top N items within every group (p4): sorted runs merged by a loser tree.

Every task sorts its rows by group and score, keeps at most N rows of a group (more of one run can never be among the
group's first N) and stores the run cut by bucket of groups. A bucket's runs are merged by a loser tree over their heads; after N
rows of a group the merge seeks, in every run, to the next group. A group of any size sends N rows a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BUCKET_ROWS = 250_000


class LoserTree:
    """Merges sorted runs of tuples; `heads` are the runs' current keys, None at a run's end."""

    def __init__(self, heads: list) -> None:
        self.k = k = max(1, len(heads))
        self.heads = heads + [None] * (k - len(heads))
        self.tree = [-1] * k
        winners = [-1] * k + list(range(k))
        for i in range(k - 1, 0, -1):
            a, b = winners[2 * i], winners[2 * i + 1]
            if self.beats(b, a):
                a, b = b, a
            winners[i], self.tree[i] = a, b
        self.tree[0] = winners[1] if k > 1 else 0

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y)

    def winner(self) -> int:
        return self.tree[0]

    def replay(self, run: int, head) -> None:
        """Run has a new head; the run must be the winner."""
        self.heads[run] = head
        tree, i, w = self.tree, (run + self.k) >> 1, run
        while i >= 1:
            if self.beats(tree[i], w):
                w, tree[i] = tree[i], w
            i >>= 1
        tree[0] = w


class Run:
    """A sorted run as columns: group (a number in the groups' order), order (the score, negated), doc_id; keys are made one by one."""

    def __init__(self, group: np.ndarray, order: np.ndarray, ids: np.ndarray) -> None:
        self.group, self.order, self.ids, self.place = group, order, ids, 0

    def head(self) -> tuple | None:
        at = self.place
        return (self.group[at], self.order[at], self.ids[at]) if at < len(self.ids) else None

    def seek(self) -> None:
        """To the next group."""
        self.place = int(np.searchsorted(self.group, self.group[self.place], "right"))


def merge_top(runs: list[Run], n: int) -> Iterator[tuple]:
    """(group, order, doc_id, place) of the first n rows of every group, in order."""
    tree = LoserTree([r.head() for r in runs])
    group, taken = None, 0
    while (head := tree.heads[w := tree.winner()]) is not None:
        if head[0] != group:
            group, taken = head[0], 0
        if taken < n:
            taken += 1
            yield *head, taken
            runs[w].place += 1
        else:
            runs[w].seek()
        tree.replay(w, runs[w].head())


def top_n(rows: DataFrame, n: int) -> DataFrame:
    """(run_id, z_hat, doc_id, z_confidence, place): the n best rows of each (run_id, z_hat), by z_confidence descending, then doc_id.

    rows: run_id string, doc_id long, z_hat int, z_confidence double, scored_at timestamp. Of several rows of one
    (run_id, doc_id) only the one of latest scored_at counts, a null time being the earliest; of equally late ones the one of
    higher score, then of higher z_hat (null lowest). Rows whose score is then null or NaN, or whose topic, run or
    doc_id is null, are left out. Infinite scores are scores. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    score = F.when(~F.isnan("z_confidence"), F.col("z_confidence"))
    last = rows.where("run_id is not null and doc_id is not null").groupBy("run_id", "doc_id").agg(F.max(F.struct(F.col("scored_at"), score.alias("s"), F.col("z_hat").alias("z"))).alias("m"))
    valid = last.select("run_id", "doc_id", F.col("m.z").alias("z_hat"), F.col("m.s").alias("z_confidence")).where("z_hat is not null and z_confidence is not null")
    # more rows are cut into more buckets, so that the runs of one fit into a task
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, rows.count() // BUCKET_ROWS)
    ordered = valid.withColumn("bucket", F.pmod(F.xxhash64("run_id", "z_hat"), F.lit(buckets)).cast("int")).sortWithinPartitions("bucket", "run_id", "z_hat", F.desc("z_confidence"), "doc_id")
    schema = "bucket int, run binary"

    def store(batches):
        held, last, seen = [], None, 0
        for b in batches:
            if not b.num_rows:
                continue
            run, z, bucket = b.column("run_id").dictionary_encode(), np.asarray(b.column("z_hat")), np.asarray(b.column("bucket"))
            code = np.asarray(run.indices)
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1]) | (z[1:] != z[:-1])]
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, len(z)])
            rank = np.arange(len(z)) - np.repeat(first, size)
            group = lambda k: (int(bucket[k]), b.column("run_id")[k].as_py(), int(z[k]))  # noqa: B023, E731
            if group(0) == last:  # goes on with the group that ended the batch before
                rank[: size[0]] += seen
            last, seen = group(len(z) - 1), int(rank[-1]) + 1
            few = b.filter(pa.array(rank < n))
            bucket = np.asarray(few.column("bucket"))
            ends = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else []
            for a, e in zip(ends[:-1], ends[1:]):
                if held and held[0][0] != bucket[a]:
                    yield packed(held)
                    held = []
                held.append((bucket[a], few.slice(a, e - a).drop_columns(["bucket"])))
        if held:
            yield packed(held)

    def packed(held):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0][1].schema) as w:
            for _, part in held:
                w.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([int(held[0][0])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "run"])

    def merge(batches):
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for k, r in zip(b.column("bucket").to_pylist(), b.column("run").to_pylist()):
                by.setdefault(k, []).append(r)
        for blobs in by.values():
            tables = [pa.ipc.open_stream(blob).read_all() for blob in blobs]
            # groups as numbers in their order, over all runs of the bucket
            names = sorted(set().union(*(t.column("run_id").unique().to_pylist() for t in tables)))
            at = {x: k for k, x in enumerate(names)}
            runs = []
            for t in tables:
                run = t.column("run_id").combine_chunks().dictionary_encode()
                run = run.combine_chunks() if isinstance(run, pa.ChunkedArray) else run
                code = np.array([at[x] for x in run.dictionary.to_pylist()], np.int64)[np.asarray(run.indices)]
                z, score, ids = (np.asarray(t.column(c).combine_chunks()) for c in ("z_hat", "z_confidence", "doc_id"))
                runs.append(Run(code << 32 | (z.astype(np.int64) + (1 << 31)), -score, ids))
            group, order, ids, place = zip(*merge_top(runs, n))
            group = np.array(group)
            cols = [pa.array([names[k] for k in group >> 32]), pa.array(((group & 0xFFFFFFFF) - (1 << 31)).astype(np.int32)), pa.array(np.array(ids)), pa.array(-np.array(order)), pa.array(np.array(place, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["run_id", "z_hat", "doc_id", "z_confidence", "place"])

    stored = ordered.select("bucket", "run_id", "z_hat", "z_confidence", "doc_id").mapInArrow(store, schema)
    return stored.repartitionById(buckets, F.col("bucket")).mapInArrow(merge, "run_id string, z_hat int, doc_id long, z_confidence double, place int")
