"""Sentences as sets of hashed words, and the symbols by which similar sets meet.

A word is a maximal run of letters and digits without regard to case and accents. It is held as a 64-bit hash;
a set as the sum of its words' mixed hashes (the *class* of all records with that set).

Two sets r, s with Jaccard >= t have at most D = (1-t)/(1+t) (|r|+|s|) words that are in one of them only.
Words in few records are *rare*, the others *frequent*. With x rare words in a set let its slack be
e = |r| (1-t)/(1+t) - x. Either r and s share a rare word, or all their rare words are unshared and at most
d = e_r + e_s frequent words are. In the second case the frequent words, dealt to m blocks, are equal in m - d blocks at
least. With m = d + 3 blocks in two groups, one group has two equal blocks: so the pairs of blocks within a group are
symbols of which every such pair shares one (for large d: single blocks, m = d + 1). The words are dealt in order
of their entropy, so that no block says much less than the others, and a symbol holds a sixth of a set's words or more.
So rare words and block symbols bring every qualifying pair together, whatever the threshold between rare and frequent is.

A symbol of nothing but empty blocks is left out wherever a set is *safe*: to break every group, fewer than two of its
blocks or none of its filled blocks must be equal, and that takes more unshared words than the set can have with any partner.
Then a symbol with words is shared too.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import repeat

import numpy as np

#: log2 of the number of counters that tell rare from frequent words: 4 M counters, 1 MB when sent to executors.
SKETCH_BITS = 22
#: Upper bounds of the sums of slacks that a level of blocks serves; they go on by STEP as far as a corpus needs.
FIRST_LEVELS, STEP = (10, 14, 20), 1.4
#: Levels of at most so many unshared words use pairs of blocks, the others single blocks.
PAIRED = 14
SIGNATURE_WORDS = 3
U = np.uint64


#: What a character gives instead of its folded form: SEP ends a record, MARK is dropped, MULTI needs the text around it.
SEP, MARK, MULTI = 1, 0xFFFFFFFE, 0xFFFFFFFF


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, folded form, powers): kind 1 letters and digits, 2 marks, 0 others; the folded form is what a character gives
    without case and marks, 0 if that is no letter or digit."""
    kinds, folds = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint32)
    # the planes between hold no assigned characters, those behind private ones
    for some in (range(0x40000), range(0xE0000, 0xE1000)):
        code = np.arange(some.start, some.stop)
        chars = list(map(chr, some))
        kinds[code] = [1 if k[0] in "LN" else 2 if k[0] == "M" else 0 for k in map(unicodedata.category, chars)]
        plain = list(map(unicodedata.normalize, repeat("NFD"), map(str.lower, chars)))
        folds[code] = np.where(kinds[code] == 1, code, np.where(kinds[code] == 2, MARK, 0))
        for c in code[np.array(plain, object) != np.array(chars, object)]:
            left = [x for x in plain[c - some.start] if unicodedata.category(x)[0] != "M"]
            folds[c] = MULTI if len(left) > 1 else MARK if not left else ord(left[0]) if unicodedata.category(left[0])[0] in "LN" else 0
    folds[0x03A3] = MULTI  # a capital sigma has two small forms
    folds[0] = SEP
    powers = np.empty(1 << 12, U)
    powers[0] = 1
    for i in range(1, len(powers)):
        powers[i] = U(int(powers[i - 1]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return kinds, folds, powers


def folded(joined: str) -> np.ndarray:
    """Of each character but marks: 0 for what separates words, SEP for what separates records, else its folded form."""
    kinds, folds, _ = _tables()
    chars = folds[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    most = chars.max(initial=0)
    if most == MULTI:
        chars = np.frombuffer(unicodedata.normalize("NFD", joined.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds[chars]
        return np.where(kind == 1, chars, chars == 0)[kind != 2].astype(np.uint32)
    return chars[chars != MARK] if most == MARK else chars


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = h.astype(U) + U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        h ^= h >> U(30)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(27)
        h *= U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def group_sum(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of values by sorted group."""
    total = np.zeros(n, U)
    if len(values):
        at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        with np.errstate(over="ignore"):
            total[group[at]] = np.add.reduceat(values, at)
    return total


#: Bits of a word's hash; the others of a 64-bit sort key hold the record's number in its piece.
HASH_BITS = 52
PIECE_RECORDS = 1 << (64 - HASH_BITS)


def words_of(texts: list[str | None], spoken: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(record number, word hash), distinct and sorted, of at most PIECE_RECORDS texts; null texts have no words.
    spoken: gets the same in the order of the texts, with repetitions."""
    powers = _tables()[2]
    joined = "\0".join(["" if t is None else t for t in texts])
    if joined.count("\0") >= len(texts) > 0:
        joined = "\0".join(["" if t is None else t.replace("\0", " ") for t in texts])
    chars = folded(joined)
    inside = np.empty(len(chars) + 2, bool)
    inside[0] = inside[-1] = False
    np.greater(chars, SEP, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, length = edge[::2], edge[1::2] - edge[::2]
    if not len(first):
        if spoken is not None:
            spoken += [np.empty(0, np.int64), np.empty(0, U)]
        return np.empty(0, np.int64), np.empty(0, U)
    total = np.cumsum(length)
    place = np.arange(total[-1]) - np.repeat(total - length, length)
    with np.errstate(over="ignore"):
        value = chars[inside[1:-1]] * U(0xC2B2AE3D27D4EB4F)
        value += U(0x165667B19E3779F9)
        value *= powers[place & 4095 if length.max() > 4096 else place]
        if length.max() > 4096:
            value += mix((place >> 12).astype(U)) * (place >= 4096)
        h = mix(np.add.reduceat(value, total - length))
    record = np.searchsorted(np.flatnonzero(chars == SEP), first).astype(U)
    key = (record << U(HASH_BITS)) | (h >> U(64 - HASH_BITS))
    if spoken is not None:
        spoken += [record.astype(np.int64), key << U(64 - HASH_BITS)]
    key = np.sort(key)
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> U(HASH_BITS)).astype(np.int64), key << U(64 - HASH_BITS)


def class_of(record: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, number of words) of each of n records."""
    size = np.bincount(record, minlength=n).astype(np.int64)
    return mix(group_sum(mix(h, 1), record, n) + size.astype(U)), size


def signature(record: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n rows of SIGNATURE_WORDS 64-bit words: the parity of the set's words at each of their bits. Every word that one of
    two sets holds alone flips one bit, so as many differ at most."""
    bit = (mix(h, 2) % U(64 * SIGNATURE_WORDS)).astype(np.int64)
    odd = np.bincount(record * (64 * SIGNATURE_WORDS) + bit, minlength=n * 64 * SIGNATURE_WORDS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, -1), axis=1, bitorder="little").view(U)


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - SKETCH_BITS)).astype(np.int64)


def levels(most: float) -> list[tuple[float, float, int]]:
    """(low, high, d) of each level: it serves sums of slacks from low up to high, of at most d unshared frequent words."""
    out, low = [], -np.inf
    for high in FIRST_LEVELS:
        if low > 2 * most:
            return out
        out.append((low, high, high - 1))
        low = high
    while low <= 2 * most:
        high = int(low * STEP) + 1
        out.append((low, high, high - 1))
        low = high
    return out


def groups(d: int) -> tuple[list[np.ndarray], int]:
    """The blocks of each group, and how many of them make a symbol."""
    if d > PAIRED:
        return [np.arange(d + 1)], 1
    m = d + 3
    return [np.arange(0, (m + 1) // 2), np.arange((m + 1) // 2, m)], 2


def symbols(record, h, n: int, state, facts, most: float, least: float, unit: float, spoken=None) -> tuple[np.ndarray, np.ndarray]:
    """(record, symbol) of each symbol of n sets, by record; first the rare words (in the order of the text, if spoken is
    given), then the block symbols.

    state: of each bucket 0 for at most one record, 1 rare, 2 + place by entropy for frequent words. facts: size, number of
    words that aren't frequent, and slack of each set; most, least: bounds of the slacks of all sets.
    """
    size, x, slack = facts
    kind = state[buckets(h)]
    r, w = (record, h) if spoken is None else spoken
    rare = np.flatnonzero((kind if spoken is None else state[buckets(w)]) == 1)
    r, w = r[rare], w[rare]
    if spoken is not None and len(r):
        first = np.sort(np.unique(mix(w, 13) ^ mix(r.astype(U), 14), return_index=True)[1])
        r, w = r[first], w[first]
    who, what = [r], [mix(w, 3)]
    often = kind >= 2
    r, w, place = record[often], h[often], kind[often].astype(np.int64) - 2
    # no partner has more words of its own than that (sizes of similar sets are similar)
    bound = np.minimum(size * (2 * unit / (1 - unit)) - x, slack + most) + 1e-4
    for low, high, d in levels(most):
        takes = (bound >= low) & (bound >= 0) & (slack + least < high + 1e-4)
        if not takes.any():
            continue
        split, k = groups(d)
        m = d + 3 if k == 2 else d + 1
        number = np.cumsum(takes) - 1
        rows = int(takes.sum())
        use = takes[r]
        lap, block = np.divmod(place[use], m)
        block = np.where(lap & 1, m - 1 - block, block)
        cell = number[r[use]] * m + block
        total = np.zeros(rows * m, U)
        np.add.at(total, cell, mix(w[use], 5))
        total = total.reshape(rows, m)
        filled = total != 0
        spare = np.minimum(np.floor(bound[takes]), d)
        safe = sum(np.minimum(len(g) - k + 1, filled[:, g].sum(1)) for g in split) > spare
        with np.errstate(over="ignore"):
            named = mix(total + mix(np.arange(m, dtype=U) + U(1000 * d)), 6)
        left = np.concatenate([np.repeat(g, len(g)) for g in split]) if k == 2 else split[0]
        right = np.concatenate([np.tile(g, len(g)) for g in split]) if k == 2 else split[0]
        if k == 2:
            left, right = left[left < right], right[left < right]
        with np.errstate(over="ignore"):
            symbol = mix(named[:, left] * U(3) + named[:, right], 7) if k == 2 else named
        keep = filled[:, left] | filled[:, right] | ~safe[:, None]
        at, col = np.nonzero(keep)
        who.append(np.flatnonzero(takes)[at])
        what.append(symbol[at, col])
    who, what = np.concatenate(who), np.concatenate(what)
    by = np.argsort(who, kind="stable")
    return who[by], what[by]
