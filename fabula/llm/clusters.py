"""Grouping records into similarity clusters (p5): bisecting k-means on directions.

Of all leaves that aren't compact those of largest dispersion are split first, WIDTH of them a round, each by 2-means over all
its vectors. The same pass gives the count n and the vector sum S of every node, and with them its dispersion n - |S| (the
sum of 1 - cosine to the node's mean direction) and its compactness |S| / n (the mean of these cosines). A leaf is compact
at COMPACT or more, the square root of min_cosine. Compact leaves are the clusters; leaves whose mean directions are
so alike (cosine (1 + min_cosine) / 2 or more) that a split has cut one cluster are put together again.

A vector belongs to the cluster whose mean direction it is most similar to, and to none below min_cosine. The vectors
that belong to none are then bisected in the same way, until they hold no compact leaf; so a small cluster that hides
beside a large one in a compact leaf comes out too.

Counts, sums, dispersions and memberships are taken over all vectors. A bounded sample (SAMPLE vectors of smallest hash, of
those looked at) only proposes the two directions that 2-means starts from; it is drawn anew from the leaves in turn where it
holds too few of one. Leaves of SAMPLE vectors or less are bisected to the end in one task each, where all their vectors
propose. So leaves are split down to min_members whatever the number of vectors is, and the tree on the driver has only
nodes of more than SAMPLE vectors and their children. Groups of fewer than min_members vectors are no cluster; copies of one
record are few, and are no cluster for that reason.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .vectors import block, dims_of, read_blocks, sample_of, unit_blocks

SAMPLE = 16_384
#: A leaf of fewer sampled vectors has the sample drawn anew.
PROPOSERS = 128
#: Nodes that are split in a round; passes over all vectors for each round of splits.
WIDTH, STEPS = 64, 2
MIN_MEMBERS = 32


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def two_means(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Two directions that split the sampled vectors of a node; none if they are all alike. The best of some starts."""
    rng = np.random.default_rng(seed)
    best, found = -1.0, None
    for _ in range(6):
        one = x[rng.integers(len(x))]
        far = np.maximum(1 - x @ one, 0).astype(np.float64) ** 2
        if far.sum() <= 1e-9:
            continue
        other = x[rng.choice(len(x), p=far / far.sum())]
        for _ in range(8):
            right = x @ other > x @ one
            if not right.any() or right.all():
                break
            a, b = x[~right].sum(0), x[right].sum(0)
            one, other = unit(a), unit(b)
        else:
            if (value := float(np.linalg.norm(a) + np.linalg.norm(b))) > best:
                best, found = value, (one, other)
    return found


class Splits:
    """The tree: node 0 is the root; a split node sends a vector to the child whose direction is nearer."""

    def __init__(self, d: int) -> None:
        self.direction = np.zeros((1, d), np.float32)
        self.children: dict[int, tuple[int, int]] = {}

    def divide(self, node: int, one: np.ndarray, other: np.ndarray) -> None:
        n = len(self.direction)
        self.direction = np.vstack([self.direction, one, other]).astype(np.float32)
        self.children[node] = (n, n + 1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for node in sorted(self.children):  # parents have smaller numbers
            rows = np.flatnonzero(at == node)
            if len(rows):
                a, b = self.children[node]
                y = x[rows]
                at[rows] = np.where(y @ self.direction[b] > y @ self.direction[a], b, a)
        return at


def sums_by(blocks: DataFrame, d: int, assign, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum of vectors) over all vectors by the number assign(vectors) gives (-1: none); one partial row a task and number."""

    def part(batches):
        count, total = np.zeros(n, np.int64), np.zeros((n, d))
        for _, v in read_blocks(batches, d):
            at = assign(v)
            ok = at >= 0
            at, v = at[ok], v[ok].astype(np.float64)
            count += np.bincount(at, minlength=n)
            order = np.argsort(at, kind="stable")
            s = at[order]
            if len(s):
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                total[s[first]] += np.add.reduceat(v[order], first)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array([total[k].tobytes() for k in some], pa.binary())], ["k", "n", "s"])

    def whole(key, table):
        s = np.sum([np.frombuffer(x) for x in table.column("s").to_pylist()], axis=0)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "s": pa.array([s.tobytes()], pa.binary())})

    count, total = np.zeros(n, np.int64), np.zeros((n, d))
    for r in blocks.select("ids", "vecs").mapInArrow(part, "k long, n long, s binary").groupBy("k").applyInArrow(whole, "k long, n long, s binary").collect():
        count[r.k], total[r.k] = r.n, np.frombuffer(r.s)
    return count, total


def nearest_leaf(centres: np.ndarray, min_cosine: float):
    centres = centres.astype(np.float32)

    def assign(v):
        if not len(centres):
            return np.full(len(v), -1)
        cos = v @ centres.T
        k = cos.argmax(1)
        return np.where(cos[np.arange(len(v)), k] >= min_cosine, k, -1)

    return assign


def of_leaves(blocks: DataFrame, d: int, tree: Splits, leaves: list[int]) -> DataFrame:
    """The vectors of these leaves, as blocks with the leaf's number as part."""

    def rows(batches):
        for ids, v in read_blocks(batches, d):
            at = tree.leaf_of(v)
            for k in np.intersect1d(at, leaves):
                yield block(int(k), ids[at == k], v[at == k])

    return blocks.select("ids", "vecs").mapInArrow(rows, "part int, n int, ids binary, vecs binary")


def compact_leaves(x: np.ndarray, compact: float, min_members: int, salt: int, steps: int) -> list[tuple[int, np.ndarray]]:
    """(count, sum of vectors) of the compact leaves of a node whose vectors are all at hand."""
    found, todo, turn = [], [x], 0
    while todo:
        x = todo.pop()
        if len(x) < min_members:
            continue
        total = x.sum(0, dtype=np.float64)
        if np.linalg.norm(total) >= compact * len(x):
            found.append((len(x), total))
            continue
        turn += 1
        if (directions := two_means(x, 1000 * salt + turn)) is None:
            continue
        one, other = directions
        for _ in range(steps):
            right = x @ other > x @ one
            if right.any() and not right.all():
                one, other = unit(x[~right].sum(0)), unit(x[right].sum(0))
        right = x @ other > x @ one
        if right.any() and not right.all():
            todo += [x[right], x[~right]]
    return found


def bisected(blocks: DataFrame, d: int, tree: Splits, leaves: list[int], compact: float, min_members: int, salt: int, steps: int) -> np.ndarray:
    """Sums of vectors of the compact leaves below these leaves, each bisected in one task; largest first."""

    def run(key, table):
        ids = np.concatenate([np.frombuffer(i, np.int64) for i in table.column("ids").to_pylist()])
        x = np.concatenate([np.frombuffer(v, np.float32).reshape(-1, d) for v in table.column("vecs").to_pylist()])
        got = compact_leaves(x[np.argsort(ids, kind="stable")], compact, min_members, salt, steps)
        return pa.table({"n": pa.array([n for n, _ in got], pa.int64()), "s": pa.array([s.tobytes() for _, s in got], pa.binary())})

    found = of_leaves(blocks, d, tree, leaves).groupBy("part").applyInArrow(run, "n long, s binary").collect()
    return np.array([np.frombuffer(r.s) for r in sorted(found, key=lambda r: (-r.n, r.s))]).reshape(-1, d)


def bisect(blocks: DataFrame, d: int, compact: float, min_members: int, salt: int = 0, steps: int = STEPS) -> np.ndarray:
    """Mean directions of the compact leaves."""
    count, total = sums_by(blocks, d, lambda v: np.zeros(len(v), np.int64), 1)
    if count[0] < min_members:
        return np.empty((0, d), np.float32)
    x, tree, closed = None, Splits(d), set()
    while True:
        tight = np.linalg.norm(total, axis=1) / np.maximum(count, 1)
        leaves = [k for k in range(len(count)) if k not in tree.children and count[k] >= min_members]
        split = [k for k in leaves if k not in closed and tight[k] < compact]
        todo = sorted((k for k in split if count[k] > SAMPLE), key=lambda k: (-count[k] * (1 - tight[k]), k))[:WIDTH]
        if not todo:
            sums = total[[k for k in leaves if tight[k] >= compact]]
            if split:
                sums = np.vstack([sums, bisected(blocks, d, tree, split, compact, min_members, salt, steps)])
            return unit(sums).astype(np.float32).reshape(-1, d)
        if x is None or np.bincount(tree.leaf_of(x), minlength=len(count))[todo].min() < PROPOSERS:
            _, x = sample_of(of_leaves(blocks, d, tree, todo), d, SAMPLE, salt)
        at = tree.leaf_of(x)
        for k in todo:
            rows = x[at == k]
            if len(rows) > 1 and (found := two_means(rows, 1000 * salt + k)) is not None:
                tree.divide(k, *found)
            elif len(rows) > 1 or len(todo) == 1:
                closed.add(k)
        fresh = range(len(count), len(tree.direction))
        for _ in range(steps if fresh else 0):  # 2-means over all vectors
            count, total = sums_by(blocks, d, tree.leaf_of, len(tree.direction))
            for k in fresh:
                if count[k]:
                    tree.direction[k] = unit(total[k])
        if fresh:  # of the leaves as the last directions make them
            count, total = sums_by(blocks, d, tree.leaf_of, len(tree.direction))


def merged(centres: np.ndarray, min_cosine: float) -> np.ndarray:
    """Centres of parts of one cluster, cut by an early split, become one: those of cosine half way from min_cosine to 1."""
    from .components import Joined

    joined = Joined()
    for i, j in zip(*np.nonzero(np.triu(centres @ centres.T >= (1 + min_cosine) / 2, 1))):
        joined.join(int(i), int(j))
    of = np.array([joined.find(i) for i in range(len(centres))], np.int64)
    return np.array([unit(centres[of == k].mean(0)) for k in np.unique(of)], np.float32).reshape(-1, centres.shape[1])


def strays(blocks: DataFrame, d: int, centres: np.ndarray, min_cosine: float) -> DataFrame:
    """The vectors that belong to none, as blocks of their own."""

    def rows(batches):
        assign = nearest_leaf(centres, min_cosine)
        for ids, v in read_blocks(batches, d):
            at = assign(v) < 0
            if at.any():
                yield block(0, ids[at], v[at])

    return cut(blocks.select("ids", "vecs").mapInArrow(rows, "part int, n int, ids binary, vecs binary").select("n", "ids", "vecs"))


def settled(blocks: DataFrame, d: int, centres: np.ndarray, min_cosine: float, min_members: int, most: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, mean directions): the mean directions over all members, until no cluster changes its size."""
    before = None
    for _ in range(most):
        count, total = sums_by(blocks, d, nearest_leaf(centres, min_cosine), max(1, len(centres)))
        kept = count >= min_members
        fresh = unit(total[kept]).astype(np.float32).reshape(-1, d)
        centres, count = merged(fresh, min_cosine), count[kept]
        if before is not None and len(centres) == len(count) and np.array_equal(before, count):
            break
        before = count if len(centres) == len(count) else None
    return count, centres


def fit(blocks: DataFrame, d: int, min_cosine: float, min_members: int = MIN_MEMBERS) -> tuple[np.ndarray, np.ndarray]:
    """(mean directions, sizes) of the clusters, largest first."""
    compact = math.sqrt(max(min_cosine, 0.0))
    centres = merged(bisect(blocks, d, compact, min_members), min_cosine)
    turn = 0
    while True:
        count, centres = settled(blocks, d, centres, min_cosine, min_members)
        turn += 1
        more = bisect(strays(blocks, d, centres, min_cosine), d, compact, min_members, turn, 1)
        # a leaf of strays is a cluster if it has its members among all of them; each turn must find one more
        grown = merged(np.vstack([centres, more]), min_cosine)
        if len(grown) == len(centres):
            break
        sizes, grown = settled(blocks, d, grown, min_cosine, min_members)
        if len(grown) <= len(centres):
            break
        centres = grown
    order = np.lexsort((np.arange(len(count)), -count))
    return centres[order], count[order]


def members(blocks: DataFrame, d: int, centres: np.ndarray, min_cosine: float) -> DataFrame:
    """(doc_id, cluster, cosine) of every vector that belongs to a cluster."""

    def rows(batches):
        for ids, v in read_blocks(batches, d):
            if len(centres):
                cos = v @ centres.T
                k = cos.argmax(1)
                best = cos[np.arange(len(v)), k]
                ok = best >= min_cosine
                yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(k[ok].astype(np.int32)), pa.array(best[ok].astype(np.float64))], ["doc_id", "cluster", "cosine"])

    return blocks.select("ids", "vecs").mapInArrow(rows, "doc_id long, cluster int, cosine double")


def clusters(wide: DataFrame, topics: DataFrame, min_cosine: float = 0.42, min_members: int = MIN_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """(records, topic of each cluster): records (doc_id, cluster, cosine), topics (cluster, size, z_cluster).

    wide: doc_id, dim_*; topics: doc_id, z_hat. z_cluster is the most frequent z_hat of the members, null and -1 left
    out, of equally frequent ones the least; null if there is none. Unusable vectors (see `vectors`) are in no cluster;
    a doc_id with several z_hat counts with the least; groups of fewer than min_members vectors are no cluster; an empty
    table gives empty results.
    """
    d = len(dims_of(wide))
    blocks = unit_blocks(wide)
    centres, sizes = fit(blocks, d, min_cosine, min_members)
    records = members(blocks, d, centres, min_cosine)
    z = topics.where("z_hat is not null and z_hat <> -1").groupBy("doc_id").agg(F.min("z_hat").alias("z_hat"))
    counts = records.join(z.hint("merge"), "doc_id").groupBy("cluster", "z_hat").count()
    best = counts.groupBy("cluster").agg(F.max(F.struct("count", (-F.col("z_hat")).alias("z"))).alias("m")).select("cluster", (-F.col("m.z")).alias("z_cluster"))
    spark = wide.sparkSession
    size = spark.createDataFrame([(k, int(n)) for k, n in enumerate(sizes)], "cluster int, size long")
    return records, size.join(best, "cluster", "left")


def typical(records: DataFrame, n: int = 5) -> DataFrame:
    """(cluster, doc_id, cosine, place): the n members nearest to each cluster's mean direction, then by doc_id."""
    # a partial top n in every task before the shuffle, so that a large cluster sends n rows a task
    w = Window.partitionBy("part", "cluster").orderBy(F.desc("cosine"), "doc_id")
    some = records.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(256))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    w = Window.partitionBy("cluster").orderBy(F.desc("cosine"), "doc_id")
    return some.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("cluster", "doc_id", "cosine", "place")
