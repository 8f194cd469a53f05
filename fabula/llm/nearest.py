"""Most similar vectors for every vector (p2): a forest of random-projection trees.

The forest is fitted on a bounded sample (SAMPLE to SAMPLE_MOST vectors of smallest hash); every vector is indexed in one leaf
of every tree. A vector also searches: besides its own leaves it visits PROBES more from one priority queue that the trees
share (`visits`). Rows of a leaf of any size are all compared; signatures of random projections
rule out pairs that are likely below min_cosine (a pair just at it is lost with probability 0.0013, in all trees alike, as a
signature is the same in each; see DEVIATIONS); what is left, however many, is reranked by exact cosines.

Equal vectors are one class (named by a 64-bit hash of its values) until results are written: a class is indexed once, and
its k + 1 least doc_ids stand for it among the neighbours, as no record needs more of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .vectors import dims_of, hash_ids, read_blocks, sample_of, unit_blocks
from .wordsets import mix

#: Vectors that the forest is fitted on, at least and at most; in between one of so many rows.
SAMPLE, SAMPLE_MOST, SAMPLE_OF = 32_768, 131_072, 256
TREES, PROBES = 8, 4
#: Rows that a leaf is meant to hold; a leaf holds LEAF_SAMPLE sampled rows or more, so leaves grow with the data in the end.
LEAF_ROWS, LEAF_SAMPLE = 256, 8
SIGNATURE_BITS = 192
#: A pair of cosine just min_cosine passes the signatures up to so many standard deviations (3: all but 0.13 %, fewer the more alike).
DEVIATIONS = 3.0
SEEN_BITS = 24
U = np.uint64


class Tree:
    """Hyperplanes through the origin; node i has children left[i], right[i], a negative number is leaf -1-number."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.planes, self.child, self.leaves = [], [], 0
        stack = [(np.arange(len(x)), None, 0)]
        while stack:
            rows, parent, side = stack.pop()
            plane = self.plane(x[rows], rng) if len(rows) > leaf else None
            if plane is None:
                me = -1 - self.leaves
                self.leaves += 1
            else:
                me = len(self.planes)
                self.planes.append(plane)
                self.child.append([0, 0])
                right = x[rows] @ plane > 0
                stack += [(rows[~right], me, 0), (rows[right], me, 1)]
            if parent is not None:
                self.child[parent][side] = me
        self.planes = np.array(self.planes, np.float32).reshape(-1, x.shape[1])
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    @staticmethod
    def plane(x: np.ndarray, rng) -> np.ndarray | None:
        """The plane between two random rows that splits the node best of some tries; none if the rows are all alike."""
        best, found = 0.02, None
        for _ in range(4):
            a, b = x[rng.integers(len(x), size=2)]
            w = a - b
            if (n := float(np.linalg.norm(w))) == 0:
                continue
            part = float((x @ (w / n) > 0).mean())
            if min(part, 1 - part) > best:
                best, found = min(part, 1 - part), w / n
            if best > 0.35:
                break
        return found

    def down(self, x: np.ndarray, node: np.ndarray | None = None, note: bool = False):
        """Leaf of each row; with note also (row, node on the other side, margin) of every split passed."""
        at = np.zeros(len(x), np.int64) if node is None else node.copy()
        if not len(self.planes):
            at[:] = -1
        passed = []
        while len(live := np.flatnonzero(at >= 0)):
            k = at[live]
            margin = np.einsum("ij,ij->i", x[live], self.planes[k])
            right = (margin > 0).astype(np.int64)
            if note:
                passed.append((live, self.child[k, 1 - right], np.abs(margin)))
            at[live] = self.child[k, right]
        return (-1 - at, passed) if note else -1 - at


def class_hashes(x: np.ndarray) -> np.ndarray:
    """The same number for equal vectors."""
    words = np.ascontiguousarray(x + np.float32(0), np.float32).view(np.uint32)  # -0 is 0
    h = np.zeros(len(x), U)
    for k in range(words.shape[1]):
        h += mix(words[:, k], 1000 + k)
    return h.view(np.int64)


def signatures(x: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(20_011)
    planes = rng.standard_normal((x.shape[1], SIGNATURE_BITS)).astype(np.float32)
    return np.packbits(x @ planes > 0, axis=1, bitorder="little").view(U)


def visits(forest: list[Tree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, leaf, indexed) of every leaf that a row is indexed in or searches.

    All trees share one priority queue a row: it holds the far side of every split passed, by the largest margin on the way
    there. Each of PROBES times the nearest far side is taken and gone down from, and the splits passed then are queued too.
    """
    everyone = np.arange(len(x))
    rows, trees, leaves, own = [], [], [], []
    margins, nodes, owners = [], [], []

    def queue(who, node, tree, margin):
        m, n, t = np.full(len(x), np.inf, np.float32), np.zeros(len(x), np.int32), np.zeros(len(x), np.uint8)
        m[who], n[who], t[who] = margin, node, tree
        margins.append(m), nodes.append(n), owners.append(t)

    for t, tree in enumerate(forest):
        leaf, passed = tree.down(x, note=True)
        rows.append(everyone), trees.append(np.full(len(x), t)), leaves.append(leaf), own.append(np.ones(len(x), bool))
        for who, far, m in passed:
            queue(who, far, t, m)
    for _ in range(PROBES if margins else 0):
        table = np.stack(margins)
        best = table.argmin(0)
        margin = table[best, everyone]
        live = np.flatnonzero(np.isfinite(margin))
        if not len(live):
            break
        node, owner = (np.stack(c)[best[live], live] for c in (nodes, owners))
        for k in np.unique(best[live]):
            margins[k][live[best[live] == k]] = np.inf
        for t, tree in enumerate(forest):
            at = np.flatnonzero(owner == t)
            leaf, passed = tree.down(x[live[at]], node[at].astype(np.int64), note=True)
            rows.append(live[at]), trees.append(np.full(len(at), t)), leaves.append(leaf), own.append(np.zeros(len(at), bool))
            for who, far, m in passed:
                queue(live[at[who]], far, t, np.maximum(m, margin[live[at[who]]]))
    return tuple(np.concatenate(c) for c in (rows, trees, leaves, own))


def candidates_of(blocks: DataFrame, d: int, forest: list[Tree], min_cosine: float, rows: int) -> DataFrame:
    """(a, b): all pairs of classes that met in a leaf and may reach min_cosine."""
    sc = blocks.sparkSession.sparkContext
    sent_forest = sc.broadcast(forest)  # bounded by the sample
    parts = max(sc.defaultParallelism, rows * (TREES + PROBES) // 400_000)
    share = math.acos(max(-1.0, min(1.0, min_cosine))) / math.pi
    limit = math.ceil(SIGNATURE_BITS * share + DEVIATIONS * math.sqrt(SIGNATURE_BITS * share * (1 - share)))

    def send(batches):
        for _, v in read_blocks(batches, d):
            ids, first = np.unique(class_hashes(v), return_index=True)
            v = v[first]
            row, tree, leaf, own = visits(sent_forest.value, v)
            sig = signatures(v)
            key = tree.astype(np.int64) << 32 | leaf
            part = (mix(key.view(U), 12) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                at = order[ends[p] : ends[p + 1]]
                if len(at):
                    who, local = np.unique(row[at], return_inverse=True)
                    blob = np.array([len(who), len(at)], np.int64).tobytes() + ids[who].tobytes() + sig[who].tobytes() + key[at].tobytes() + local.astype(np.uint32).tobytes() + own[at].astype(np.uint8).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([blob], pa.binary())], ["part", "payload"])

    width = SIGNATURE_BITS // 64

    def join(batches):
        ids, sigs, keys, local, own, base = [], [], [], [], [], 0
        for b in batches:
            for x in b.column("payload").to_pylist():
                n, m = np.frombuffer(x, np.int64, 2)
                at = 16
                ids.append(np.frombuffer(x, np.int64, n, at)), sigs.append(np.frombuffer(x, U, n * width, at := at + 8 * n).reshape(-1, width))
                keys.append(np.frombuffer(x, np.int64, m, at := at + 8 * n * width)), local.append(np.frombuffer(x, np.uint32, m, at := at + 8 * m).astype(np.int64) + base)
                own.append(np.frombuffer(x, np.uint8, m, at + 4 * m))
                base += int(n)
        if not ids:
            return
        ids, sigs, keys, local, own = map(np.concatenate, (ids, sigs, keys, local, own))
        order = np.lexsort((1 - own, ids[local], keys))
        keys, local, own = keys[order], local[order], own[order]
        # a class that came from several blocks counts once in a leaf
        fresh = np.r_[True, (keys[1:] != keys[:-1]) | (ids[local[1:]] != ids[local[:-1]])]
        keys, local, own = keys[fresh], local[fresh], own[fresh]
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        out, n = [], 0
        for a, b in zip(bounds[:-1], bounds[1:]):
            rows = local[a:b]
            mine = own[a:b] == 1
            there = rows[mine]
            for lo in range(0, len(there), 1024):
                some = there[lo : lo + 1024]
                for q in range(0, len(rows), 1024):
                    ask = rows[q : q + 1024]
                    apart = np.bitwise_count(sigs[ask, 0][:, None] ^ sigs[some, 0])
                    for w in range(1, width):
                        apart += np.bitwise_count(sigs[ask, w][:, None] ^ sigs[some, w])
                    i, j = np.nonzero(apart <= min(limit, 255))
                    i, j = ids[ask[i]], ids[some[j]]
                    ok = i != j
                    out.append((np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])))
                    n += int(ok.sum())
                    if n > 1_000_000:
                        yield pairs(out)
                        out, n = [], 0
        if n:
            yield pairs(out)

    def pairs(out):
        i, j = (np.concatenate(x) for x in zip(*out))
        o = np.lexsort((j, i))
        i, j = i[o], j[o]
        keep = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        return pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(j[keep])], ["a", "b"])

    sent = blocks.select("ids", "vecs").mapInArrow(send, "part int, payload binary").repartitionById(parts, F.col("part"))
    return cut(sent.mapInArrow(join, "a long, b long").distinct())


def exact(blocks: DataFrame, d: int, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of the pairs of classes; only vectors that occur in pairs are sent, told apart by a bitmap of fixed size."""

    def mark(batches):
        bits = np.zeros(1 << SEEN_BITS, bool)
        for b in batches:
            for name in ("a", "b"):
                bits[(hash_ids(np.asarray(b.column(name))) >> U(64 - SEEN_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["k", "bits"])

    def either(key, table):
        at = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"k": pa.array([0], pa.int32()), "bits": pa.array([at.tobytes()], pa.binary())})

    got = pairs.mapInArrow(mark, "k int, bits binary").groupBy("k").applyInArrow(either, "k int, bits binary").collect()
    known = pairs.sparkSession.sparkContext.broadcast(np.frombuffer(got[0].bits, np.uint8) if got else np.zeros(1 << (SEEN_BITS - 3), np.uint8))

    def rows(batches):
        for _, v in read_blocks(batches, d):
            ids, first = np.unique(class_hashes(v), return_index=True)
            v = v[first]
            at = (hash_ids(ids) >> U(64 - SEEN_BITS)).astype(np.int64)
            use = np.flatnonzero((known.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array([v[i].tobytes() for i in use], pa.binary())], ["id", "v"])

    vecs = blocks.select("ids", "vecs").mapInArrow(rows, "id long, v binary").groupBy("id").agg(F.first("v").alias("v"))
    both = pairs.join(vecs.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vecs.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")

    def cosine(batches):
        for b in batches:
            va, vb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(-1, d).astype(np.float64) for c in ("va", "vb"))
            cos = np.einsum("ij,ij->i", va, vb) / np.sqrt(np.einsum("ij,ij->i", va, va) * np.einsum("ij,ij->i", vb, vb)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(cos)], ["a", "b", "cosine"])

    return both.select("a", "b", "va", "vb").mapInArrow(cosine, "a long, b long, cosine double")


def most_similar(wide: DataFrame, k: int = 5, min_cosine: float = 0.5, sample: int | None = None) -> DataFrame:
    """(doc_id, other_id, cosine, place): for every usable vector its k most similar others of cosine min_cosine or more,
    by cosine descending, then other_id ascending; place from 1.

    Vectors with a null, NaN or infinite dimension or of length zero take no part; rows delivered again count once; equal
    vectors of several records are neighbours of cosine one; an empty table gives an empty result. sample: vectors that the
    forest is fitted on.
    """
    d = len(dims_of(wide))
    blocks = unit_blocks(wide)
    rows = blocks.agg(F.sum("n")).first()[0] or 0
    _, x = sample_of(blocks, d, sample or min(max(SAMPLE, rows // SAMPLE_OF), SAMPLE_MOST))
    leaf = max(LEAF_SAMPLE, LEAF_ROWS * len(x) // max(1, rows))
    x = x[np.sort(np.unique(class_hashes(x), return_index=True)[1])]
    forest = [Tree(x, leaf, 7 + t) for t in range(TREES)] if len(x) else []
    scored = exact(blocks, d, candidates_of(blocks, d, forest, min_cosine, rows)).where(F.col("cosine") >= min_cosine)
    ways = scored.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("other")), F.struct(F.col("b").alias("c"), F.col("a").alias("other")))).alias("w"), "cosine").select("w.*", "cosine")
    return expand(ways, *classes_of(blocks, d, k), k, min_cosine)


def classes_of(blocks: DataFrame, d: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(c, doc_id) of all records, and (c, n, least): of every class its size and its k + 1 least doc_ids in order."""

    def docs(batches):
        for ids, v in read_blocks(batches, d):
            yield pa.RecordBatch.from_arrays([pa.array(class_hashes(v)), pa.array(ids)], ["c", "doc_id"])

    def least(batches):
        for ids, v in read_blocks(batches, d):
            c = class_hashes(v)
            order = np.lexsort((ids, c))
            c, ids = c[order], ids[order]
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            size = np.diff(np.r_[first, len(c)])
            # a block sends at most k + 1 doc_ids of a class, and its size with the first of them
            place = np.arange(len(c)) - np.repeat(first, size)
            at = place <= k
            yield pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(np.where(place == 0, np.repeat(size, size), 0)[at]), pa.array(ids[at])], ["c", "n", "doc_id"])

    packed = blocks.select("ids", "vecs")
    sizes = packed.mapInArrow(least, "c long, n long, doc_id long").groupBy("c").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_list("doc_id")), 1, k + 1).alias("least"))  # k + 1 a block
    return packed.mapInArrow(docs, "c long, doc_id long"), sizes


def expand(ways: DataFrame, docs: DataFrame, sizes: DataFrame, k: int, min_cosine: float) -> DataFrame:
    """The neighbours of records from those of classes: ways has (c, other, cosine)."""
    own = sizes.where(f"n > 1 and {min_cosine} <= 1").select("c", F.lit(1.0).alias("cosine"), "least")
    w = Window.partitionBy("c").orderBy(F.desc("cosine"), F.col("least")[0])
    near = ways.join(sizes.select(F.col("c").alias("other"), "least"), "other").select("c", "cosine", "least").union(own)
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    # a record's neighbours are the first k of its class's first k + 1 besides itself
    each = F.transform("least", lambda i: F.struct((-F.col("cosine")).alias("minus"), i.alias("other_id")))
    lists = near.groupBy("c").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k + 1).alias("near"))  # (k + 1) * (k + 1) at most
    got = docs.join(lists, "c").select("doc_id", F.posexplode(F.slice(F.filter("near", lambda x: x["other_id"] != F.col("doc_id")), 1, k)).alias("at", "x"))
    return got.select("doc_id", F.col("x.other_id").alias("other_id"), (-F.col("x.minus")).alias("cosine"), (F.col("at") + 1).alias("place"))
