"""Encoding of texts with a public byte-pair tokenizer (p8), by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that its encoding can end with. An automaton over the vocabulary
gives the tokens that end at a place, longest first; the last token of the prefix is the one that is compatible with the
last token of the prefix before it, where two tokens are compatible if merging their bytes gives just these two. Following
the last tokens back from the end emits the piece's ids. Pieces and pairs already seen are remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary cuts a text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered pieces and pairs of a worker; beyond, it starts afresh.
REMEMBERED = 400_000


class Vocabulary:
    """Ranks of byte strings, and what is needed to encode by prefixes."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(PATTERN).findall
        self.bytes = {r: b for b, r in self.ranks.items()}
        self.ends = ahocorasick.Automaton()
        for b, r in self.ranks.items():
            self.ends.add_word(b.decode("latin-1"), (r, len(b)))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self)
        self.sizes = Sizes(self)

    def merged(self, data: bytes) -> list[int]:
        """Byte-pair merging as defined: always the adjacent pair of least rank, the leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def whole(self, a: int) -> bool:
        key = -1 - a
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merged(self.bytes[a]) == [a]
        return known

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        if (r := self.ranks.get(data)) is not None and self.whole(r):
            return [r]
        last = [-1] * (len(data) + 1)
        size = [0] * (len(data) + 1)
        for end, (token, n) in self.ends.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - n
                if self.whole(token) if start == 0 else last[start] >= 0 and self.compatible(last[start], token):
                    last[end], size[end] = token, n
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def ids(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            if len(self.pieces) > REMEMBERED:
                self.pieces.clear()
            for p in map(self.pieces.__getitem__, self.find(text)):
                out += p
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.sizes) > REMEMBERED:
            self.sizes.clear()
        return sum(map(self.sizes.__getitem__, self.find(text)))


class Pieces(dict):
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, text: str) -> list[int]:
        self[text] = ids = self.vocabulary.piece(text)
        return ids


class Sizes(Pieces):
    def __missing__(self, text: str) -> int:
        self[text] = n = len(self.vocabulary.piece(text))
        return n


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, ids): token ids of each row's whole text without special tokens; strings that look like special tokens are
    ordinary text. Null and empty texts give an empty list; rows keep their number, repeated and null ids included; extra
    columns are ignored. path: the vocabulary file, on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        v = vocabulary(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                flat, ends = [], [0]
                for t in part.column("text").to_pylist():
                    flat += v.ids(t)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(docs: DataFrame, keys: list[str], path: str = DEFAULT_PATH) -> DataFrame:
    """keys and tokens, the number of token ids of text (0 for null and empty texts)."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]):
        v = vocabulary(path)
        for batch in batches:
            n = pa.array([v.count(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), n], [*keys, "tokens"])

    return docs.select(*keys, "text").mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", tokens long")
