"""Usable vectors of a wide table (`doc_id`, `dim_*`), packed into blocks: (n, ids, vecs), vecs of length one in float32.

A row takes part if no dimension is null or NaN or infinite and its length is not zero; a doc_id counts once (of several
usable rows the least by its first two dimensions). Extra columns are ignored; an empty table gives no block.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLOCK_ROWS = 8192


def dims_of(df: DataFrame) -> list[str]:
    """The dim_* columns by number."""
    return sorted((c for c in df.columns if re.fullmatch(r"dim_\d+", c)), key=lambda c: int(c[4:]))


def unit_blocks(wide: DataFrame, rows_hint: int | None = None) -> DataFrame:
    """Blocks in the shared folder. One shuffle by doc_id, of packed vectors."""
    dims = dims_of(wide)
    d = len(dims)
    rows = wide.count() if rows_hint is None else rows_hint
    parts = max(wide.sparkSession.sparkContext.defaultParallelism, rows // 40_000)

    def pack(batches):
        for b in batches:
            ids = b.column("doc_id")
            known = np.asarray(ids.is_valid())
            x = np.stack([np.asarray(b.column(c).to_numpy(zero_copy_only=False), np.float64) for c in dims], axis=1) if b.num_rows else np.empty((0, d))
            with np.errstate(all="ignore"):
                scale = np.abs(x).max(1, initial=0)
                ok = known & np.isfinite(x).all(1) & (scale > 0)
                x = x[ok] / scale[ok, None]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
            i = np.asarray(ids.to_numpy(zero_copy_only=False))[ok].astype(np.int64)
            part = (hash_ids(i) % np.uint64(parts)).astype(np.int64)
            for p in np.unique(part):
                at = part == p
                yield block(int(p), i[at], x[at].astype(np.float32))

    def merge(batches):
        ids, vecs = [], []
        for b in batches:
            for i, v in zip(b.column("ids").to_pylist(), b.column("vecs").to_pylist()):
                ids.append(np.frombuffer(i, np.int64))
                vecs.append(np.frombuffer(v, np.float32).reshape(-1, d))
        if ids:
            i, v = np.concatenate(ids), np.concatenate(vecs)
            order = np.lexsort((v[:, min(1, d - 1)], v[:, 0], i))
            i, v = i[order], v[order]
            keep = np.r_[True, i[1:] != i[:-1]]
            i, v = i[keep], v[keep]
            for k in range(0, len(i), BLOCK_ROWS):
                yield block(0, i[k : k + BLOCK_ROWS], v[k : k + BLOCK_ROWS])

    schema = "part int, n int, ids binary, vecs binary"
    sent = wide.select("doc_id", *dims).mapInArrow(pack, schema).repartitionById(parts, F.col("part"))
    return cut(sent.mapInArrow(merge, schema).select("n", "ids", "vecs"))


def block(part: int, ids: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(vecs).tobytes()], pa.binary())], ["part", "n", "ids", "vecs"])


def hash_ids(ids: np.ndarray) -> np.ndarray:
    from .wordsets import mix

    return mix(ids.astype(np.int64).view(np.uint64), 11)


def read_blocks(batches, d: int):
    for b in batches:
        for i, v in zip(b.column("ids").to_pylist(), b.column("vecs").to_pylist()):
            yield np.frombuffer(i, np.int64), np.frombuffer(v, np.float32).reshape(-1, d)


def sample_of(blocks: DataFrame, d: int, most: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` (ids, vectors): those of smallest hash, whatever the partitioning. The count of all rows sets a threshold
    on the hash first, so about 1.3 x most rows are sent; in the rare case of fewer than most, a higher one is used."""
    from .wordsets import mix

    total = blocks.agg(F.sum("n")).first()[0] or 0
    share = 1.3 * most / max(1, total)
    while True:
        limit = np.uint64(min(2**64 - 1, int(share * 2**64)))

        def pick(batches, limit=limit):
            for i, v in read_blocks(batches, d):
                at = mix(i.view(np.uint64), 100 + salt) < limit
                if at.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i[at].tobytes()], pa.binary()), pa.array([v[at].tobytes()], pa.binary())], ["ids", "vecs"])

        got = blocks.select("ids", "vecs").mapInArrow(pick, "ids binary, vecs binary").collect()  # bounded by the threshold
        ids = np.frombuffer(b"".join(r.ids for r in got), np.int64)
        if len(ids) >= min(most, total) or share >= 1:
            break
        share *= 2
    vecs = np.frombuffer(b"".join(r.vecs for r in got), np.float32).reshape(-1, d)
    order = np.lexsort((ids, mix(ids.view(np.uint64), 100 + salt)))[:most]
    return ids[order], vecs[order]
