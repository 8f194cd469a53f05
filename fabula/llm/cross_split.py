"""Same or near-same records across splits (p1): a compressed full-text index of evaluation shards.

A record's text is the string of its symbols that fall into a shard: its rare words as the text has them, then its block
symbols (see `wordsets`); symbols that only one side of a shard holds match nothing and are left out. The evaluation side
of a shard is an FM index: the Burrows-Wheeler column of all its strings as a wavelet matrix, a bit a level with
a sampled rank for every 128 of them, and the strings of the rows. Training strings stream through it backward.
An occurrence is found where it can't go on to the right; of those that signatures let pass, backward steps to
the left go on to the whole maximal match. Matches are merged by pair, with the number of spans and of matched symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlap import Shard, candidates, close, merged, tile, verified

TRAIN, EVALUATION = 1, 2
#: Occurrences worked off at once, so few that their arrays stay in the cache; those that signatures let pass are held up to HELD.
CHUNK, HELD = 100_000, 500_000
#: Symbols of so many meetings, with so many classes a side, are worked off by tiles; classes of either side in a tile.
TILED, TILE_LEAST, TILE = 1 << 14, 32, (256, 512)
#: Places ranked at once.
RANKED = 1 << 15
U = np.uint64


class WaveletMatrix:
    """A column of codes below 2**levels: levels x 1.25 bits a code."""

    def __init__(self, codes: np.ndarray, levels: int) -> None:
        self.n, self.levels, self.words, self.ranks, self.zeros = len(codes), levels, [], [], []
        for k in reversed(range(levels)):
            bit = (codes >> k & 1).astype(np.uint8)
            packed = np.packbits(np.r_[bit, np.zeros(-len(bit) % 128 + 128, np.uint8)], bitorder="little").view(U)
            self.words.append(packed)
            self.ranks.append(np.r_[0, np.cumsum(np.bitwise_count(packed).reshape(-1, 2).sum(1))[:-1]].astype(np.uint32))
            self.zeros.append(self.n - int(bit.sum()))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    def ones(self, k: int, i: np.ndarray) -> np.ndarray:
        """Set bits of level k before each place i."""
        words, part, at = self.words[k], (i & 63).astype(U), i >> 6
        inside = np.bitwise_count(words[at] & ((U(1) << part) - U(1))).astype(np.int64)
        return self.ranks[k][at >> 1] + inside + np.where(at & 1, np.bitwise_count(words[at & ~1]), 0)

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place of i in the order of the last level: a code's start there plus its number before i."""
        out = i.astype(np.int64)
        for p in range(0, len(out), RANKED):
            i, part = out[p : p + RANKED], code[p : p + RANKED]
            for k in range(self.levels):
                one = self.ones(k, i)
                i = np.where(part >> (self.levels - 1 - k) & 1, self.zeros[k] + one, i - one)
            out[p : p + RANKED] = i
        return out

    def take(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes at i, and `rank` of each."""
        i, code = i.astype(np.int64), np.zeros(len(i), np.int64)
        for k in range(self.levels):
            bit = (self.words[k][i >> 6] >> (i & 63).astype(U) & U(1)).astype(np.int64)
            one = self.ones(k, i)
            i = np.where(bit, self.zeros[k] + one, i - one)
            code = code << 1 | bit
        return code, i


class FullTextIndex:
    """FM index of many short strings of codes 1..codes; every string ends with code 0."""

    def __init__(self, string: np.ndarray, code: np.ndarray, codes: int) -> None:
        """string: number of the string of each symbol, ascending without gaps; code: its symbol."""
        n_strings = int(string[-1]) + 1 if len(string) else 0
        n = len(string) + n_strings
        place = np.arange(len(string)) + string
        text, owner = np.zeros(n, np.int64), np.zeros(n, np.int64)
        text[place], owner[place] = code, string
        ends = np.flatnonzero(text == 0)
        owner[ends] = np.arange(n_strings)
        # suffix order by prefix doubling; an end mark is followed by nothing
        rank = text.copy()
        rank[ends] = -np.arange(n_strings)[::-1] - 1
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) if n else np.empty(0, np.int64)
        order, step = np.argsort(rank, kind="stable"), 1
        while n and step <= left.max():
            after = np.where(left >= step, rank[np.minimum(np.arange(n) + step, n - 1)], -n - 1)
            both = (rank + n) * (2 * max(n, codes) + 2) + after + n + 1
            order = np.argsort(both)
            both = both[order]
            new = np.zeros(n, np.int64)
            new[order] = np.cumsum(np.r_[0, both[1:] != both[:-1]])
            if new[order[-1]] == n - 1:
                break
            rank, step = new, step * 2
        before = np.where(order > 0, text[np.maximum(order - 1, 0)], 0)
        self.owner = owner[order].astype(np.uint32)
        self.starts = np.searchsorted(text[order], np.arange(codes + 2)).astype(np.int32)
        self.column = WaveletMatrix(before, max(1, int(codes).bit_length()))
        self.shift = (self.starts[:-1] - self.column.rank(np.arange(codes + 1), np.zeros(codes + 1, np.int64))).astype(np.int32)

    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.owner, self.starts, self.shift, *self.column.words, *self.column.ranks))

    def interval(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[code], self.starts[code + 1]

    def back(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of code followed by the match of [lo, hi)."""
        return self.column.rank(code, lo) + self.shift[code], self.column.rank(code, hi) + self.shift[code]

    def before(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol before each row's suffix (0: none), and the row of the suffix that starts there."""
        code, at = self.column.take(row)
        return code, at + self.shift[code]

    def matched(self, text: np.ndarray, first: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Length of the match that ends with symbol text[at] at each row, extended backward as far as it goes; first: first
        place of the string in text."""
        length = np.ones(len(at), np.int64)
        live = np.flatnonzero(at > first)
        row, place = row.astype(np.int64), at - 1
        while len(live):
            code, up = self.before(row[live])
            on = code == text[place[live]]
            live = live[on]
            length[live] += 1
            row[live] = up[on]
            place[live] -= 1
            live = live[place[live] >= first[live]]
        return length


def by_code(text: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(code, its places in text) of the codes marked in which."""
    at = np.flatnonzero(which[text])
    at = at[np.argsort(text[at], kind="stable")]
    for places in np.split(at, np.flatnonzero(np.diff(text[at])) + 1) if len(at) else ():
        yield int(text[places[0]]), places


class Sized:
    """Classes of a list in order of their size, in place of a shard."""

    def __init__(self, shard: Shard, *lists: np.ndarray) -> None:
        self.order = [np.argsort(shard.size[x], kind="stable") for x in lists]
        cls = np.concatenate([x[o] for x, o in zip(lists, self.order)])
        self.sig, self.size = shard.sig[cls], shard.size[cls]


def tiles(shard: Shard, unit: float, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places (in a, in b) of classes that may qualify, of all pairs of two long lists; blocks whose sizes are too far
    apart are skipped."""
    both, n = Sized(shard, a, b), len(a)
    size = both.size[n:]
    for p in range(0, n, TILE[0]):
        left = np.arange(p, min(p + TILE[0], n))
        # |r| - |s| is unshared at least
        first = int(np.searchsorted(size * (1 + unit), both.size[p] * (1 - unit) - 1e-6))
        end = int(np.searchsorted(size * (1 - unit), both.size[left[-1]] * (1 + unit) + 1e-6, "right"))
        for q in range(first, end, TILE[1]):
            i, j = tile(both, unit, left, np.arange(n + q, n + min(q + TILE[1], end)))
            if len(i):
                yield both.order[0][i], both.order[1][j - n]


def cross_pairs(shard: Shard, unit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(training, evaluation, matched symbols) of the maximal matches of classes of a shard that may qualify."""
    ev, tr = ((shard.side[shard.doc] & side) > 0 for side in (EVALUATION, TRAIN))
    # symbols of both sides get codes 1..codes in order of the symbols
    at = np.sort(shard.sym.astype(U) << U(32) | np.arange(len(shard.sym), dtype=U))
    sym, at = at >> U(32), (at & U(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1]][: len(sym)])
    if not len(starts):
        return
    shared = np.logical_or.reduceat(ev[at], starts) & np.logical_or.reduceat(tr[at], starts)
    codes = int(shared.sum())
    if not codes:
        return
    code = np.zeros(len(sym), np.int64)
    code[at] = np.repeat(np.where(shared, np.cumsum(shared), 0), np.diff(starts, append=len(sym)))
    both = code > 0
    names, string = np.unique(shard.doc[ev & both], return_inverse=True)
    index = FullTextIndex(string, code[ev & both], codes)
    doc, text = shard.doc[tr & both], code[tr & both]
    new = np.r_[True, doc[1:] != doc[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    room = (shard.size * unit + 1e-4).astype(np.float32)
    sign, spare = [shard.sig[names, k][index.owner] for k in (0, 1)], room[names][index.owner]
    mine, left = [shard.sig[doc, k] for k in (0, 1)], room[doc]
    held: list[tuple[np.ndarray, ...]] = []

    def matches():
        i, j, where, row = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return i, j, index.matched(text, first[where], where, row)

    lo, hi = index.interval(text)
    occurs, rows = np.bincount(text, minlength=codes + 1), np.diff(index.starts)
    long = (np.minimum(occurs, rows) >= TILE_LEAST) & (occurs * rows.astype(np.int64) >= TILED)
    # where the match goes on with the next symbol, its occurrences belong to a longer match
    inner_lo, inner_hi = lo.copy(), lo.copy()
    at = np.flatnonzero(~np.r_[new[1:], True])
    inner_lo[at], inner_hi[at] = index.back(text[at], lo[at + 1], hi[at + 1])
    for c, where in by_code(text, long):
        for p, row in tiles(shard, unit, doc[where], names[index.owner[index.starts[c] : index.starts[c + 1]]]):
            p, row = where[p], row + index.starts[c]
            ok = (doc[p] != names[index.owner[row]]) & ((row < inner_lo[p]) | (row >= inner_hi[p]))
            held.append((doc[p[ok]], names[index.owner[row[ok]]], p[ok], row[ok]))
            if sum(len(x[0]) for x in held) > HELD:
                yield matches()
    for a, b in ((lo, np.where(inner_hi > inner_lo, inner_lo, hi)), (inner_hi, np.where(inner_hi > inner_lo, hi, inner_hi))):
        use = np.flatnonzero((b > a) & ~long[text])
        total = np.cumsum(b[use] - a[use])
        p = done = 0
        while done < (total[-1] if len(use) else 0):
            # a chunk of occurrences, also of part of one interval
            stop = min(done + CHUNK, int(total[-1]))
            q = int(np.searchsorted(total, stop))
            u = use[p : q + 1]
            start = a[u].copy()
            n = (b[u] - a[u]).astype(np.int64)
            before = int(total[p - 1]) if p else 0
            start[0] += done - before
            n[0] -= done - before
            n[-1] -= int(total[q]) - stop
            sums = np.cumsum(n)
            row = np.arange(sums[-1]) + np.repeat(start - sums + n, n)
            # two words of the signatures first, for the evaluation side in the order of the rows
            apart = np.bitwise_count(np.repeat(mine[0][u], n) ^ sign[0][row])
            apart += np.bitwise_count(np.repeat(mine[1][u], n) ^ sign[1][row])
            at = np.flatnonzero(apart <= np.repeat(left[u], n) + spare[row])
            row, where = row[at], u[np.searchsorted(sums, at, "right")]
            i, j = doc[where], names[index.owner[row]]
            ok = np.flatnonzero(i != j)
            ok = ok[close(shard, unit, i[ok], j[ok])]
            held.append((i[ok], j[ok], where[ok], row[ok]))
            if sum(len(x[0]) for x in held) > HELD:
                yield matches()
            done, p = stop, q if int(total[q]) > stop else q + 1
    if held:
        yield matches()


def cross_split(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id_a, doc_id_b, overlap, spans), a < b: pairs of a training and an evaluation record whose word sets overlap by
    the threshold or more; spans: maximal matches of their symbol strings, 0 for records of the same word set.

    docs: doc_id long, text string, side int (1 training, 2 evaluation; other values take no part). Rows delivered again
    count once and further columns are ignored; null, empty and blank texts and texts with under 5 distinct words have no
    partner; an empty table gives an empty result. Copies are held as one class until the result is written.
    """
    docs = docs.select("doc_id", "text", F.col("side").cast("int").alias("side")).where("doc_id is not null and text is not null and side in (1, 2)")
    found, members = candidates(docs, threshold, cross_pairs)
    links = verified(docs, members, merged(found), threshold).select("a", "b", (F.col("shared") / F.col("total")).alias("overlap"), "spans")
    train = members.where(F.col("side") == TRAIN).select(F.col("class").alias("a"), F.col("doc_id").alias("x"))
    evaluation = members.where(F.col("side") == EVALUATION).select(F.col("class").alias("b"), F.col("doc_id").alias("y"))
    same = members.where(F.col("side") == EVALUATION).select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("overlap"), F.lit(0).cast("long").alias("spans")).distinct()
    pairs = links.union(same).join(train, "a").join(evaluation, "b").where("x <> y")
    # a record delivered with two texts or on both sides may come by several ways
    return pairs.groupBy(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).agg(F.max("overlap").alias("overlap"), F.max("spans").alias("spans"))
