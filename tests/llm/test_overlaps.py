import collections
import itertools
import random
import unicodedata

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from fabula.llm import cross_split as cross_split_module
from fabula.llm import wordsets as ws
from fabula.llm.components import Joined, components
from fabula.llm.cross_split import FullTextIndex, cross_split
from fabula.llm.near_duplicates import near_duplicates
from fabula.llm.overlap import Shard, close, frequency_states

SCHEMA = "doc_id long, text string, side int, class string, words int, a double"


def words(text):
    if text is None:
        return frozenset()
    plain = regex.sub(r"\p{M}", "", unicodedata.normalize("NFD", text.lower()))
    return frozenset(regex.findall(r"[\p{L}\p{N}]+", plain))


def overlap(a, b):
    return len(a & b) / len(a | b) if len(a) >= 5 and len(b) >= 5 else 0


def corpus(n, seed, vocabulary=90):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.5:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], ["mot%d" % rng.randrange(500)], [t[k], "et"]])
                t = t or ["x"]
            if rng.random() < 0.3:
                rng.shuffle(t)
            texts.append(" ".join(t))
        else:
            texts.append(" ".join("w%d" % min(int(rng.expovariate(0.05)), vocabulary) for _ in range(rng.randint(3, 45))) + f" été{i}")
    return texts


def rows_of(texts, rng):
    rows = [(i, t, rng.choice([1, 2, None]), "c", 1, None) for i, t in enumerate(texts)]
    rows += [(10_000, None, 1, None, None, 1.0), (10_001, "", 2, None, 1, 1.0), (10_002, " \n ", 1, None, 1, 1.0), (10_003, "un deux trois", 1, None, 1, 1.0), (10_004, "un deux trois", 2, None, 1, 1.0), (None, texts[0], 1, None, 1, 1.0)]
    rows += [(10_005, "Ｅ\0 " + "très " * 3 + " ".join(f"long{k}" for k in range(30_000)), 1, "x", 1, 1.0), (10_006, " ".join(f"LONG{k}" for k in range(30_000)) + " tres", 2, "x", 1, 1.0)]
    return rows + rows[:7]  # delivered again


def test_near_duplicates_equal_brute_force(spark):
    for seed, t, dense in ((1, 0.7, 0), (2, 0.8, 32), (3, 0.5, 1)):
        rows = rows_of(corpus(150, seed), random.Random(seed))
        got = {(r.doc_id, r.group_doc_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), t, dense).collect()}
        sets = {i: words(x) for i, x, *_ in rows if i is not None}
        up = {i: i for i in sets}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in itertools.combinations(sets, 2):
            if overlap(sets[x], sets[y]) >= t - 1e-12:
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
        groups = collections.defaultdict(list)
        for x in sets:
            groups[find(x)].append(x)
        assert got == {(d, min(g)) for g in groups.values() if len(g) > 1 for d in g}


def test_cross_split_equals_brute_force(spark):
    for seed, t in ((4, 0.7), (5, 0.8)):
        rows = rows_of(corpus(150, seed), random.Random(seed))
        found = cross_split(spark.createDataFrame(rows, SCHEMA), t).collect()
        sets, sides = {i: words(x) for i, x, *_ in rows if i is not None}, {r[0]: r[2] for r in rows}
        want = {(x, y) for x, y in itertools.combinations(sorted(sets), 2) if {sides[x], sides[y]} == {1, 2} and overlap(sets[x], sets[y]) >= t - 1e-12}
        assert {tuple(r)[:2] for r in found} == want and len(found) == len(want)
        assert all(abs(r.overlap - overlap(sets[r.doc_id_a], sets[r.doc_id_b])) < 1e-12 and (r.spans > 0) == (r.overlap < 1) for r in found)


def test_hot_group_of_copies_and_empty_tables(spark):
    rows = [(i, "le meme texte de cinq mots et plus", 1 + i % 2, None, 1, 1.0) for i in range(600)] + [(i, f"autre texte numero {i} sur un chantier", 1, None, 1, 1.0) for i in range(600, 1800)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(df, 0.95).collect()
    assert len(got) == 600 and {r.group_doc_id for r in got} == {0}
    assert cross_split(df.where("doc_id < 40"), 0.95).count() == 400
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).count() == 0 and cross_split(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=40), st.sampled_from(["Été ÉTÉ été", "a\0b", "ⅷ²x", "ǅ ß"])), max_size=12))
def test_words(texts):
    record, h = ws.words_of(texts)
    for i, t in enumerate(texts):
        mine = words(t.replace("\0", " ") if t else t)
        assert (record == i).sum() == len(mine)
    same = {}
    for i, t in enumerate(texts):
        key = words(t.replace("\0", " ") if t else t)
        cls = ws.class_of(record, h, len(texts))[0][i]
        assert same.setdefault(key, cls) == cls


def test_index_counts_every_match():
    rng = np.random.default_rng(6)
    strings = [np.sort(rng.choice(np.arange(1, 9), rng.integers(1, 6), replace=False)) for _ in range(60)]
    ix = FullTextIndex(np.repeat(np.arange(60), [len(s) for s in strings]), np.concatenate(strings), 8)
    text = ["-".join(map(str, s)) + "-" for s in strings]
    for a in range(1, 9):
        lo, hi = ix.interval(np.array([a]))
        assert sorted(ix.owner[lo[0] : hi[0]]) == [i for i, s in enumerate(strings) if a in s]
        for b in range(1, 9):
            l2, h2 = ix.back(np.array([b]), lo, hi)
            want = [i for i, s in enumerate(strings) if any(x == b and y == a for x, y in zip(s, s[1:]))]
            assert sorted(ix.owner[l2[0] : h2[0]]) == want, text
    # every row's suffix, read backward, gives its string; matches go on as far as the strings agree
    for a in range(1, 9):
        lo, hi = ix.interval(np.array([a]))
        for s in strings:
            for k in np.flatnonzero(s == a):
                for row in range(lo[0], hi[0]):
                    other = list(strings[ix.owner[row]])
                    m, n = other.index(a), 0
                    while n <= min(k, m) and s[k - n] == other[m - n]:
                        n += 1
                    assert ix.matched(s, np.array([0]), np.array([k]), np.array([row]))[0] == n


def test_index_is_smaller_than_its_text():
    rng = np.random.default_rng(8)
    ix = FullTextIndex(np.repeat(np.arange(20_000), 8), rng.integers(1, 1 << 12, 160_000), 1 << 12)
    assert ix.bytes() < 8 * 160_000


def test_group_of_many_variants(spark):
    """Texts of one template with other numbers: a group however many, and few computed pairs."""
    base = "un macon reprenait le scellement pres de la grue quand une plaque est tombee sur le chantier apres la pluie du matin et le chef a appele"
    rows = [(i, f"{base} mesure {i} centimetres" + (" hier" if i % 3 else ""), 1, None, 1, 1.0) for i in range(3000)]
    rows += [(5000 + i, " ".join(f"x{(i * k) % 997}y{k}" for k in range(20)), 1, None, 1, 1.0) for i in range(500)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.7).collect()
    assert len([r for r in got if r.doc_id < 5000]) == 3000 and {r.group_doc_id for r in got if r.doc_id < 5000} == {0}


def test_components(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3), (4, None)]
    links += [(2000, k) for k in range(2001, 2100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), small=5).collect()}
    assert len({r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}) == len(set(got.values()))
    j = Joined()
    for a, b in links:
        if a is not None and b is not None and a != b:
            j.join(a, b)
    nodes = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    assert set(got) == nodes
    for x, y in itertools.combinations(sorted(nodes), 2):
        assert (got[x] == got[y]) == j.same(x, y)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def shard_of(n, words, seed, list_of=1):
    """A shard of n classes of so many words, on sides by turns, all of which sent the symbols of list_of."""
    rng = np.random.default_rng(seed)
    h = np.sort(ws.mix(rng.integers(0, 1 << 40, (n, words)).astype(np.uint64)), axis=1)
    h[1::10, : words - 3] = h[::10, : words - 3]  # every tenth has a partner
    record = np.repeat(np.arange(n), words)
    cls, size = ws.class_of(record, h.ravel(), n)
    return Shard([Shard.pack(cls, ws.signature(record, h.ravel(), n), size, 1 + np.arange(n) % 2, np.repeat(np.arange(n), list_of), np.tile(np.arange(list_of), n))])


def test_signatures_rule_out_most_meetings_before_classes_are_looked_up(monkeypatch):
    looked_up, seen = [], []
    monkeypatch.setattr(cross_split_module, "close", lambda shard, unit, i, j: (looked_up.append(len(i)), close(shard, unit, i, j))[1])
    shard = shard_of(2000, 48, 9, list_of=3)
    a, b = np.meshgrid(np.flatnonzero(shard.side == 1), np.flatnonzero(shard.side == 2), indexing="ij")
    ok = close(shard, 0.3 / 1.7, a.ravel(), b.ravel())
    for tiled in (1 << 60, cross_split_module.TILED):  # one by one, and long lists by tiles
        monkeypatch.setattr(cross_split_module, "TILED", tiled)
        found = sorted((i, j, m) for x in cross_split_module.cross_pairs(shard, 0.3 / 1.7) for i, j, m in zip(*(y.tolist() for y in x)))
        assert {x[:2] for x in found} == set(zip(a.ravel()[ok].tolist(), b.ravel()[ok].tolist())) and len(found) >= 200
        assert {x[2] for x in found} == {3}  # whole matches, each once
        seen.append(found)
    assert seen[0] == seen[1] and sum(looked_up) < 0.02 * 1000 * 1000


def test_rare_words_of_a_large_corpus_stay_rare(spark):
    """0.05 % of 40 million rows is rare, however many rows that are."""
    docs = spark.range(20_000).selectExpr("'commun ' || id text")
    h = ws.words_of(["commun"])[1]
    assert frequency_states(docs, 40_000_000)[ws.buckets(h)][0] == 1
    assert frequency_states(docs, 1_000_000)[ws.buckets(h)][0] >= 2


def test_every_character_folds_as_the_normal_form_does():
    for t in ["Éáß", "ΟΔΟΣ ΣΑΣ", "한국어 가", "İıǅͅx", "a̸=b\0c̣", "Å\0\0é", "́", ""]:
        want = []
        for c in unicodedata.normalize("NFD", t.lower()):
            k = unicodedata.category(c)[0]
            if k != "M":
                want.append(1 if c == "\0" else ord(c) if k in "LN" else 0)
        assert ws.folded(t).tolist() == want
