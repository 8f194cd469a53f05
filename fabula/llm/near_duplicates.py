"""Near-duplicate records with small edits (p7): set-relation skipping.

A shard's index keeps a list of classes for every symbol, cut into blocks by set size. Two blocks of one list are skipped
unseen when their sizes rule out every pair (an overlap of t needs sizes within a factor of t); signatures then
rule out most pairs of the rest.

Lists of classes that are nearly all alike aren't worked off pair by pair. The answers of a set are derived from those of a
similar one: each class of such a list is compared with a leader only (a class that no earlier leader may be
similar to is the next one), and where candidates are many, one of each class is computed before the others. Computed answers
join the classes to groups; what they leave open, pairs of different groups, is compared afterwards, so no link between
groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import wordsets as ws
from .components import components
from .overlap import Shard, candidates, close, merged, tile, verified

BLOCK, SMALL, CHUNK = 256, 40, 1_000_000
#: A list with more candidate pairs than so many a class is worked off by leaders.
DENSE = 32


def lists_of(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes by symbol, first and end of each symbol's list."""
    order = np.argsort(shard.sym, kind="stable")
    sym = shard.sym[order]
    first = np.flatnonzero(np.r_[True, sym[1:] != sym[:-1]]) if len(sym) else np.empty(0, np.int64)
    return shard.doc[order], first, np.r_[first[1:], len(sym)] if len(first) else first


def self_pairs(shard: Shard, unit: float, dense: int = DENSE) -> Iterator[tuple[np.ndarray, np.ndarray] | bytes]:
    """Pairs of classes that may qualify, and dense lists as bytes. What lies within a dense list that is kept already is
    left to that one, pairs of short lists and whole lists alike."""
    doc, first, end = lists_of(shard)
    length = end - first
    kept = Kept(len(shard.cls))
    long = np.flatnonzero(length > SMALL)
    for at in long[np.argsort(-length[long], kind="stable")]:
        members = np.sort(doc[first[at] : end[at]])
        if kept.covers(members):
            continue
        found, n = [], 0
        for i, j in by_size(shard, unit, members):
            found.append((np.minimum(i, j), np.maximum(i, j)))
            n += len(i)
            if n > dense * len(members):
                break
        else:
            yield from found
            continue
        yield from by_leaders(shard, unit, members, kept.joined)
        kept.add(members)
    for members in kept.lists():
        yield Shard.pack(shard.cls[members], shard.sig[members], shard.size[members], shard.side[members])
    # short lists: all their pairs at once, in chunks
    short = (length > 1) & (length <= SMALL)
    n = length[short]
    place = np.repeat(first[short], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    todo = np.repeat(end[short], n) - place - 1
    total = np.cumsum(todo)
    lo = 0
    while lo < len(place):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK)))
        n = todo[lo:hi]
        left = np.repeat(place[lo:hi], n)
        right = left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = doc[left], doc[right]
        ok = (kept.of[i] != kept.of[j]) | ~kept.dense[i]
        i, j = i[ok], j[ok]
        ok = close(shard, unit, i, j)
        i, j = i[ok], j[ok]
        yield np.minimum(i, j), np.maximum(i, j)
        lo = hi


class Kept:
    """The dense lists that a shard keeps; lists that share a class become one, so a class is kept once."""

    def __init__(self, n: int) -> None:
        self.dense = np.zeros(n, bool)
        self.of = np.arange(n)
        self.joined = np.arange(n)  # which classes leaders have joined

    def covers(self, members: np.ndarray) -> bool:
        """Are all of a list's classes in one kept list?"""
        return bool(self.dense[members[0]] and (self.of[members] == self.of[members[0]]).all())

    def add(self, members: np.ndarray) -> None:
        self.dense[members] = True
        self.of[np.isin(self.of, np.unique(self.of[members]))] = self.of[members[0]]

    def lists(self) -> Iterator[np.ndarray]:
        at = np.flatnonzero(self.dense)
        at = at[np.argsort(self.of[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(self.of[at])) + 1
        yield from (x for x in np.split(at, cuts) if len(x))


def by_size(shard, unit: float, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a list, block by block; blocks whose sizes are too far apart are skipped."""
    members = members[np.argsort(shard.size[members], kind="stable")]
    size = shard.size[members]
    for p in range(0, len(members), BLOCK):
        a = members[p : p + BLOCK]
        # |r| - |s| is unshared at least
        most = int(np.searchsorted(size * (1 - unit), size[min(p + BLOCK, len(size)) - 1] * (1 + unit) + 1e-6, "right"))
        for q in range(p, most, BLOCK):
            i, j = tile(shard, unit, a, members[q : q + BLOCK])
            if q == p:
                ok = i < j
                i, j = i[ok], j[ok]
            yield i, j


def by_leaders(shard, unit: float, members: np.ndarray, joined: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a dense list with leaders, but for those whose ends earlier pairs join; joined: a label for each class."""
    left = members
    while len(left) > 1:
        lead, left = left[0], left[1:]
        ok = close(shard, unit, np.full(len(left), lead), left)
        mine = left[ok]
        left = left[~ok]
        # of the classes that are joined among themselves one is enough
        label, at = np.unique(joined[mine], return_index=True)
        new = label != joined[lead]
        if new.any():
            yield np.full(int(new.sum()), lead), mine[at[new]]
            joined[np.isin(joined, label[new])] = joined[lead]


class Listed:
    """The classes of one dense list, in place of a shard."""

    def __init__(self, sig: np.ndarray, size: np.ndarray) -> None:
        self.sig, self.size = sig, size


def across(shard: Listed, unit: float, component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a list that may qualify and whose ends computed answers haven't joined."""
    order = np.argsort(component, kind="stable")
    starts = np.arange(0, len(order), BLOCK)
    low, high = component[order[starts]], component[order[np.minimum(starts + BLOCK, len(order)) - 1]]
    for p, s in enumerate(starts):
        a = order[s : s + BLOCK]
        for q in np.flatnonzero((low[p:] != low[p]) | (high[p:] != low[p]) | (high[p] != low[p])) + p:
            b = order[starts[q] : starts[q] + BLOCK]
            i, j = tile(shard, unit, a, b)
            ok = component[i] < component[j] if p == q else component[i] != component[j]
            yield i[ok], j[ok]


def open_pairs(dense: DataFrame, comp: DataFrame, unit: float) -> DataFrame:
    """(a, b): what the computed answers leave open in the dense lists (work)."""

    def rows(batches):
        for batch in batches:
            for name, blob in zip(batch.column("list").to_pylist(), batch.column("work").to_pylist()):
                s = Shard([blob])
                n = len(s.cls)
                cols = [pa.array(np.full(n, name)), pa.array(s.cls.view(np.int64)), pa.array([x.tobytes() for x in s.sig], pa.binary()), pa.array(s.size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["list", "class", "sig", "size"])

    def compare(key, table):
        cls = np.asarray(table.column("class").combine_chunks())
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), ws.U).reshape(-1, ws.SIGNATURE_WORDS)
        shard = Listed(sig, np.asarray(table.column("size").combine_chunks()))
        got = [(cls[i], cls[j]) for i, j in across(shard, unit, np.asarray(table.column("component").combine_chunks())) if len(i)]
        a, b = (np.concatenate(x) for x in zip(*got)) if got else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    lists = dense.select(F.xxhash64("work").alias("list"), "work").dropDuplicates(["list"]).mapInArrow(rows, "list long, class long, sig binary, size int")
    full = lists.join(comp.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    return full.select("list", "class", "sig", "size", "component").groupBy("list").applyInArrow(compare, "a long, b long").distinct()


def unjoined(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a, b = (comp.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("a", "b"))
    full = pairs.join(a, "a", "left").join(b, "b", "left")
    return full.where("_a is null or _b is null or _a <> _b").select(pairs.columns)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, dense: int = DENSE) -> DataFrame:
    """(doc_id, group_doc_id): every record of a group of two or more, with the group's smallest doc_id.

    docs: doc_id long, text string; rows delivered again count once, further columns are ignored. Null, empty and blank
    texts and texts with under 5 distinct words are in no group; exact copies are in one group; an empty table gives
    an empty result.
    """
    docs = docs.select("doc_id", F.col("text"), F.lit(1).alias("side")).where("doc_id is not null and text is not null")
    found, members = candidates(docs, threshold, lambda shard, unit: self_pairs(shard, unit, dense))
    pairs = cut(merged(found))
    if pairs.count() > members.count():
        # many candidates: one of each class is computed first, and of the rest those whose ends computed links don't join
        first = pairs.groupBy("b").agg(F.min("a").alias("a")).join(pairs, ["a", "b"])
        links = cut(verified(docs, members, cut(first.select(pairs.columns)), threshold).select("a", "b"))
        pairs = cut(unjoined(pairs, components(links)))
        links = cut(links.union(verified(docs, members, pairs, threshold).select("a", "b")))
    else:
        links = cut(verified(docs, members, pairs, threshold).select("a", "b"))
    comp = components(links)
    lists = found.where("work is not null")
    if not lists.isEmpty():
        more = cut(open_pairs(lists, comp, (1 - threshold) / (1 + threshold)).withColumns({"spans": F.lit(1).cast("long"), "matched": F.lit(1).cast("long")}))
        comp = components(links.union(verified(docs, members, more, threshold).select("a", "b")))
    rows = members.select("class", "doc_id").join(comp.withColumnRenamed("node", "class"), "class", "left").select("doc_id", F.coalesce("component", "class").alias("component"))
    heads = rows.groupBy("component").agg(F.min("doc_id").alias("group_doc_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(heads, "component").select("doc_id", "group_doc_id")
