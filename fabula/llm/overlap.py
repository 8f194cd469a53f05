"""Records whose word sets overlap: the shared stages of cross-split overlap (p1) and near-duplicate groups (p7).

    sketch    counters of word frequency (fixed size)                            one read of the texts
    members   (class, doc_id, side): exact copies become one class               one read
    shards    every class sends its symbols, once each, to the shards by hash     one read
    join      in a shard: candidate pairs from the operator's own index
    verify    exact Jaccard of the word sets of the candidates                    one read

Nothing is all-pairs: two classes meet only under a shared symbol (see `wordsets`). Copies are never expanded here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import wordsets as ws

#: Texts are worked off in pieces of about so many characters (one longer text is one piece).
PIECE_CHARS = 250_000
RANGES = 64
#: A word in more than this share of the rows, and in more than so many, is frequent. Any value gives the same result; an
#: upper bound of rows would make all words of a fixed vocabulary frequent in a large corpus, and block symbols weak.
RARE_SHARE, RARE_LEAST = 0.0025, 64
MIN_WORDS = 5
SEEN_BITS = 24
PLACES = 65_000
U = np.uint64
PAIRS = "a long, b long, spans int, matched int, work binary"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        texts = batch.column("text").to_numpy(zero_copy_only=False).tolist()
        ends = np.cumsum([len(t or "") + 1 for t in texts]) // PIECE_CHARS
        cuts = np.flatnonzero(np.diff(ends, prepend=0)) if len(ends) else []
        at = sorted({0, *map(int, cuts), *range(0, len(texts), ws.PIECE_RECORDS), len(texts)})
        for a, b in zip(at, at[1:]):
            yield batch.slice(a, b - a), texts[a:b]


def frequency_states(docs: DataFrame, rows: int) -> np.ndarray:
    """For each of 2**SKETCH_BITS counters of words: 0 seen at most once, 1 rare, else frequent: 2 and the place by entropy
    (modulo PLACES). Counts cover all rows; only counters of frequent words reach the driver, RARE_SHARE bounds their number."""
    limit = max(RARE_LEAST, int(RARE_SHARE * rows))
    width = (1 << ws.SKETCH_BITS) // RANGES

    def count(batches):
        total = np.zeros(1 << ws.SKETCH_BITS, np.uint32)
        for _, texts in pieces(batches):
            np.add.at(total, ws.buckets(ws.words_of(texts)[1]), 1)
        for r in range(RANGES):
            part = total[r * width : (r + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([at.astype(np.uint32).tobytes() + part[at].tobytes()], pa.binary())], ["range", "counts"])

    def states(key, table):
        total = np.zeros(width, np.int64)
        for blob in table.column("counts").to_pylist():
            x = np.frombuffer(blob, np.uint32).reshape(2, -1)
            total[x[0]] += x[1]
        often = np.flatnonzero(total > limit)
        cols = [pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.packbits(total > 1), often, total[often]))]
        return pa.Table.from_arrays(cols, ["range", "bits", "often", "n"])

    found = docs.select("text").mapInArrow(count, "range int, counts binary").groupBy("range").applyInArrow(states, "range int, bits binary, often binary, n binary").collect()
    state = np.zeros(1 << ws.SKETCH_BITS, np.uint16)
    at, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for r in found:
        state[r["range"] * width : (r["range"] + 1) * width] = np.unpackbits(np.frombuffer(r.bits, np.uint8))
        at.append(np.frombuffer(r.often, np.int64) + r["range"] * width)
        n.append(np.frombuffer(r.n, np.int64))
    at, n = np.concatenate(at), np.concatenate(n)
    share = np.clip(n / max(1, rows), 1e-9, 1 - 1e-9)
    entropy = share * np.log(share) + (1 - share) * np.log1p(-share)
    state[at[np.lexsort((at, entropy))]] = 2 + np.arange(len(at)) % PLACES
    return state


def _facts(texts: list, state: np.ndarray, unit: float, spoken: list | None = None):
    """(record, word), class, (size, words that aren't frequent, slack) of each text of a piece."""
    record, h = ws.words_of(texts, spoken)
    n = len(texts)
    cls, size = ws.class_of(record, h, n)
    x = np.bincount(record[state[ws.buckets(h)] < 2], minlength=n)
    return record, h, cls, (size, x, size * unit - x)


def members_of(docs: DataFrame, state, unit: float) -> DataFrame:
    """(class, doc_id, side, slack) of the records with at least MIN_WORDS words, one row each."""

    def rows(batches):
        for batch, texts in pieces(batches):
            _, _, cls, (size, _, slack) = _facts(texts, state.value, unit)
            ok = pa.array(size >= MIN_WORDS)
            out = [pa.array(cls.view(np.int64)), batch.column("doc_id"), batch.column("side"), pa.array(slack.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(out, ["class", "doc_id", "side", "slack"]).filter(ok)

    return docs.select("doc_id", "text", "side").mapInArrow(rows, "class long, doc_id long, side int, slack float").dropDuplicates(["class", "doc_id", "side"])


class Shard:
    """What a shard holds: classes with size, side and signature, and the symbols they sent, by class in the order sent."""

    FIELDS = (("cls", U, 1), ("sig", U, ws.SIGNATURE_WORDS), ("size", np.int32, 1), ("side", np.uint8, 1))

    @staticmethod
    def pack(cls, sig, size, side, doc=(), sym=()) -> bytes:
        """doc: the class of each symbol, ascending; sent as a count for each class."""
        count = np.bincount(np.asarray(doc, np.int64), minlength=len(cls))
        head = np.array([len(cls), len(sym)], np.int64).tobytes()
        parts = [np.ascontiguousarray(x, t).tobytes() for x, (_, t, _) in zip((cls, sig, size, side), Shard.FIELDS)]
        return b"".join([head, *parts, count.astype(np.uint32).tobytes(), np.asarray(sym, np.uint32).tobytes()])

    def __init__(self, blobs: list[bytes]) -> None:
        got, count, sym = {k: [] for k, _, _ in self.FIELDS}, [], []
        for b in blobs:
            (nd, ne), at = np.frombuffer(b, np.int64, 2), 16
            for k, t, w in self.FIELDS:
                x = np.frombuffer(b, t, nd * w, at)
                got[k].append(x.reshape(nd, w) if w > 1 else x)
                at += x.nbytes
            count.append(np.frombuffer(b, np.uint32, nd, at))
            sym.append(np.frombuffer(b, np.uint32, ne, at + 4 * nd))
        self.cls, first, inverse = np.unique(np.concatenate(got["cls"]), return_index=True, return_inverse=True)
        self.sig, self.size = (np.concatenate(got[k])[first] for k in ("sig", "size"))
        self.side = np.zeros(len(self.cls), np.uint8)
        np.bitwise_or.at(self.side, inverse, np.concatenate(got["side"]))
        # a class that several tasks sent has the same symbols from all of them; the first entry counts
        count = np.concatenate(count).astype(np.int64)
        start, n = (np.cumsum(count) - count)[first], count[first]
        self.doc = np.repeat(np.arange(len(first)), n)
        self.sym = np.concatenate(sym)[np.arange(len(self.doc)) + np.repeat(start - np.cumsum(n) + n, n)]


def shards_of(docs: DataFrame, state, unit: float, most: float, least: float, parts: int) -> DataFrame:
    """Rows (part, payload): the symbols of all classes, packed by shard."""

    def flush(held):
        cls, sig, size, side = (np.concatenate(x) for x in zip(*(h[:4] for h in held)))
        base = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
        doc = np.concatenate([h[4] + b for h, b in zip(held, base)])
        sym = np.concatenate([h[5] for h in held])
        part = ((sym >> U(32)) % U(parts)).astype(np.int64)
        # 16-bit numbers are sorted by radix
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            at = order[ends[p] : ends[p + 1]]
            if len(at):
                mine = doc[at]  # ascending
                new = np.r_[True, mine[1:] != mine[:-1]]
                who, local = mine[new], np.cumsum(new) - 1
                blob = Shard.pack(cls[who], sig[who], size[who], side[who], local, sym[at] & U(0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([blob], pa.binary())], ["part", "payload"])

    def send(batches):
        held, rows = [], 0
        for batch, texts in pieces(batches):
            spoken: list = []
            record, h, cls, (size, x, slack) = _facts(texts, state.value, unit, spoken)
            side = np.asarray(batch.column("side")).astype(np.uint8)
            n = len(texts)
            # copies of one class in this piece become one; null and short texts send nothing
            uniq, first, inverse = np.unique(cls, return_index=True, return_inverse=True)
            sides = np.zeros(len(uniq), np.uint8)
            np.bitwise_or.at(sides, inverse, side)
            kept = np.flatnonzero(size[first] >= MIN_WORDS)
            if not len(kept):
                continue
            at = first[kept]
            new = np.full(n, -1)
            new[at] = np.arange(len(kept))
            # records keep their order among the kept ones
            by = np.argsort(at, kind="stable")
            at, kept = at[by], kept[by]
            new[at] = np.arange(len(kept))
            use, said = new[record] >= 0, new[spoken[0]] >= 0
            record, h = new[record[use]], h[use]
            who, sym = ws.symbols(record, h, len(kept), state.value, (size[at], x[at], slack[at]), most, least, unit, (new[spoken[0][said]], spoken[1][said]))
            held.append((cls[at], ws.signature(record, h, len(kept)), size[at], sides[kept], who, sym))
            rows += len(kept)
            if rows > 30_000:
                yield from flush(held)
                held, rows = [], 0
        if held:
            yield from flush(held)

    return docs.select("text", "side").mapInArrow(send, "part int, payload binary")


def verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, spans, matched, shared, total): the pairs of classes whose word sets overlap by at least the threshold, exactly.

    Only one record of each class that occurs in pairs sends its words; a bitmap of fixed size (2**SEEN_BITS bits) over
    doc_id tells most others apart before their texts are split.
    """

    def mark(batches):
        bits = np.zeros(1 << SEEN_BITS, bool)
        for b in batches:
            bits[seen_at(b)] = True
        for r in range(RANGES):
            at = np.packbits(bits.reshape(RANGES, -1)[r])
            if at.any():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([at.tobytes()], pa.binary())], ["range", "bits"])

    def either(key, table):
        at = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([at.tobytes()], pa.binary())})

    seen = np.zeros((RANGES, (1 << SEEN_BITS) // RANGES // 8), np.uint8)
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    heads = members.groupBy("class").agg(F.min("doc_id").alias("doc_id")).join(ends, "class", "left_semi").select("doc_id")
    for r in heads.mapInArrow(mark, "range int, bits binary").groupBy("range").applyInArrow(either, "range int, bits binary").collect():
        seen[r["range"]] = np.frombuffer(r.bits, np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(seen.ravel())

    def marked(batch):
        at = seen_at(batch)
        return batch.filter(pa.array(((known.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)))

    def words(batches):
        for _, texts in pieces(marked(b) for b in batches):
            record, h = ws.words_of(texts)
            cls, size = ws.class_of(record, h, len(texts))
            first = np.zeros(len(cls), bool)
            first[np.unique(cls, return_index=True)[1]] = True
            ends = np.cumsum(size)
            h = (h >> U(64 - ws.HASH_BITS)).astype(np.uint32)
            out = [(int(cls[i].view(np.int64)), h[ends[i] - size[i] : ends[i]].tobytes()) for i in np.flatnonzero(first & (size >= MIN_WORDS))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["class", "words"])

    sets = docs.select("doc_id", "text").mapInArrow(words, "class long, words binary").groupBy("class").agg(F.first("words").alias("words"))
    full = pairs.join(sets.select(F.col("class").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("class").alias("b"), F.col("words").alias("wb")), "b")

    def compare(batches):
        for batch in batches:
            shared, total = [], []
            for p, q in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist()):
                p, q = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                shared.append(both)
                total.append(len(p) + len(q) - both)
            shared, total = np.array(shared, np.int32), np.array(total, np.int32)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "spans", "matched")), pa.array(shared), pa.array(total)], ["a", "b", "spans", "matched", "shared", "total"])
            yield out.filter(pa.array(shared >= threshold * total - 1e-9))

    return full.select("a", "b", "spans", "matched", "wa", "wb").mapInArrow(compare, "a long, b long, spans long, matched long, shared int, total int")


def seen_at(batch: pa.RecordBatch) -> np.ndarray:
    return (ws.mix(np.asarray(batch.column("doc_id")).view(U), 9) >> U(64 - SEEN_BITS)).astype(np.int64)


def collected(cls: np.ndarray, found) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, spans, matched, work) of what a search yields: (i, j[, matched]) arrays, merged by pair, and work as bytes."""
    held, n = [], 0

    def out():
        i, j, m = (np.concatenate(x) for x in zip(*held))
        key, first, inverse = np.unique(i * len(cls) + j, return_index=True, return_inverse=True)
        spans, matched = np.bincount(inverse), np.bincount(inverse, m).astype(np.int32)
        a, b = cls[key // len(cls)].view(np.int64), cls[key % len(cls)].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(spans.astype(np.int32)), pa.array(matched), pa.nulls(len(a), pa.binary())], ["a", "b", "spans", "matched", "work"])

    for x in found:
        if isinstance(x, bytes):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([x], pa.binary())], ["a", "b", "spans", "matched", "work"])
        elif len(x[0]):
            held.append((x[0].astype(np.int64), x[1].astype(np.int64), x[2] if len(x) > 2 else np.ones(len(x[0]), np.int64)))
            n += len(x[0])
            if n > 2_000_000:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def candidates(docs: DataFrame, threshold: float, search: Callable) -> tuple[DataFrame, DataFrame]:
    """(found, members): found as `collected` gives it, members (class, doc_id, side, slack).

    docs: doc_id long, text string, side int (1, 2: which side of the search; all 1 for a self-join).
    search(shard, unit): yields what `collected` takes, for the positions of the classes of a shard that may qualify.
    """
    spark = docs.sparkSession
    unit = (1 - threshold) / (1 + threshold)
    rows = docs.count()
    state = spark.sparkContext.broadcast(frequency_states(docs, rows))
    members = cut(members_of(docs, state, unit))
    ends = members.agg(F.max("slack"), F.min("slack")).first()
    # slacks come as 32-bit floats
    most, least = (float(x or 0) + sign * (1e-3 + 1e-6 * abs(x or 0)) for x, sign in zip(ends, (1, -1)))
    parts = max(spark.sparkContext.defaultParallelism, rows // 60_000)

    def join(batches):
        blobs = [x for b in batches for x in b.column("payload").to_pylist()]
        if not blobs:
            return
        shard = Shard(blobs)
        del blobs
        yield from collected(shard.cls, search(shard, unit))

    return cut(shards_of(docs, state, unit, most, least, parts).repartitionById(parts, F.col("part")).mapInArrow(join, PAIRS)), members


def merged(found: DataFrame) -> DataFrame:
    """(a, b, spans, matched): pairs once, with the matches of all shards."""
    return found.where("work is null").groupBy("a", "b").agg(F.sum("spans").alias("spans"), F.sum("matched").alias("matched"))


def close(shard, unit: float, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs may qualify, by size and by the words that the signatures prove unshared."""
    apart = np.bitwise_count(shard.sig[i] ^ shard.sig[j]).sum(1, dtype=np.int32)
    a, b = shard.size[i], shard.size[j]
    return np.maximum(apart, abs(a - b)) <= (a + b) * unit + 1e-6


_held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def tile(shard, unit: float, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i of a, j of b) that may qualify; a and b of moderate length. Works in arrays that fit the cache."""
    shape = (len(a), len(b))
    if shape not in _held:
        if len(_held) > 200:
            _held.clear()
        _held[shape] = np.empty(shape, U), np.empty(shape, np.uint8), np.empty(shape, np.uint8)
    bits, apart, more = _held[shape]
    # all but the last word for every pair, the last for those that are left
    for k in range(ws.SIGNATURE_WORDS - 1):
        np.bitwise_xor(shard.sig[a, k][:, None], shard.sig[b, k], out=bits)
        np.bitwise_count(bits, out=more if k else apart)
        if k:
            apart += more
    top = min(250, int((shard.size[a].max() + shard.size[b].max()) * unit + 1e-4))
    if int(apart.min()) > top:
        return a[:0], b[:0]
    i, j = np.divmod(np.flatnonzero(apart <= top), len(b))
    left, right = a[i], b[j]
    last = np.bitwise_count(shard.sig[left, -1] ^ shard.sig[right, -1])
    ok = apart[i, j].astype(np.int32) + last <= (shard.size[left] + shard.size[right]) * unit + 1e-6
    return left[ok], right[ok]
