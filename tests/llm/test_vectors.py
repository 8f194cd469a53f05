from collections import defaultdict

import numpy as np
import pyarrow as pa

from fabula.llm import nearest
from fabula.llm.clusters import clusters, fit, typical
from fabula.llm.nearest import most_similar
from fabula.llm.vectors import unit_blocks


def wide(spark, x, ids=None, extra=()):
    d = x.shape[1]
    rows = [(int(i), "btp", *[None if v is None else float(v) for v in r], "n") for i, r in zip(ids if ids is not None else range(len(x)), x.tolist())]
    return spark.createDataFrame(rows + list(extra), "doc_id long, corpus string, " + ", ".join(f"dim_{k + 1} float" for k in range(d)) + ", vecs string")


def dirty(d):
    good = [1.0] * d
    return [(None, "btp", *good, "n"), (90_001, "btp", *([None] + good[1:]), "n"), (90_002, "btp", *([float("nan")] + good[1:]), "n"), (90_003, "btp", *([0.0] * d), "n"), (90_004, "btp", *([float("inf")] + good[1:]), "n")]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1500:] = x[:1500] + 0.12 * rng.normal(size=(1500, 16))
    x[40:49] = x[39] * np.arange(2, 11)[:, None]  # copies of other lengths
    df = wide(spark, x, extra=dirty(16))
    df = df.union(df.limit(50))
    got = {(r.doc_id, r.other_id) for r in most_similar(df, 5, 0.94).collect()}
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    want = set()
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), -np.round(c[i], 6)))[:5]
        want |= {(i, int(j)) for j in order if c[i, j] >= 0.9401}
    sure = {p for p in want if p[0] not in range(39, 49)}
    assert len(sure & got) >= 0.97 * len(sure)
    assert all(sum(1 for a, _ in got if a == k) == 5 for k in range(39, 49))
    assert all(c[i, j] >= 0.9399 for i, j in got) and max(map(max, got)) < 90_000


def test_recall_with_large_leaves(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 16)).astype(np.float32)
    x[10_000:] = x[:10_000] + 0.12 * rng.normal(size=(10_000, 16))
    forest = [nearest.Tree(x[:40], 10, 7 + t) for t in range(nearest.TREES)]
    assert max(np.bincount(forest[0].down(x))) > 3000
    got = {(r.doc_id, r.other_id) for r in most_similar(wide(spark, x), 5, 0.94, sample=40).where("doc_id % 50 = 0").collect()}
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(0, len(x), 50):
        c = u @ u[i]
        c[i] = -2
        want |= {(i, int(j)) for j in np.argsort(-c)[:5] if c[j] >= 0.9401}
    assert len(want) > 300 and len(want & got) >= 0.95 * len(want)


def test_queue_is_shared_by_the_trees():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    forest = [nearest.Tree(x, 20, t) for t in range(3)]
    row, tree, leaf, own = nearest.visits(forest, x)
    for i in range(0, 300, 17):
        heap, want = [], []
        for t, f in enumerate(forest):
            heap.append((0.0, t, 0))
            for _ in range(1):
                want.append((t, walk(f, x[i], t, 0, 0.0, heap)))
                heap = [h for h in heap if h != (0.0, t, 0)]
        for _ in range(nearest.PROBES):
            m, t, node = min(heap)
            heap.remove((m, t, node))
            want.append((t, walk(forest[t], x[i], t, node, m, heap)))
        mine = row == i
        assert sorted(zip(tree[mine].tolist(), leaf[mine].tolist())) == sorted(want) and own[mine].sum() == 3


def walk(f, v, t, node, margin, heap):
    """Down a tree, far sides onto the heap; the plain version of what `visits` does for all rows at once."""
    while node >= 0:
        m = float(np.einsum("j,j->", v, f.planes[node]))
        heap.append((max(margin, abs(m)), t, int(f.child[node, 0 if m > 0 else 1])))
        node = int(f.child[node, 1 if m > 0 else 0])
    return -1 - node


def test_hot_group_and_empty(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((2500, 8)) + 0.01 * rng.normal(size=(2500, 8)), rng.normal(size=(300, 8))]).astype(np.float32)
    got = most_similar(wide(spark, x), 3, 0.9)
    assert got.where("doc_id < 2500").count() == 7500
    assert most_similar(wide(spark, x[:0]), 3, 0.9).count() == 0
    assert unit_blocks(wide(spark, x[:0], extra=dirty(8))).count() == 0
    assert nearest.Tree(np.ones((50, 4), np.float32), 5, 1).leaves == 1


def test_equal_vectors_of_a_hot_group(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 8)).astype(np.float32)
    x[rng.permutation(4000)[:1500]] = x[0]  # in any order among the others
    x[3990:3993] = x[3989]
    ids = rng.permutation(4000) + 7
    got = {(r.doc_id, r.place): r.other_id for r in most_similar(wide(spark, x, ids), 5, 0.9999999).collect()}
    equal = defaultdict(list)
    for i, v in zip(ids.tolist(), x):
        equal[v.tobytes()].append(i)
    want = {(i, n + 1): o for g in equal.values() for i in g for n, o in enumerate([o for o in sorted(g)[:6] if o != i][:5])}
    assert got == want and len(want) > 7500


def test_more_close_neighbours_than_any_pool(spark):
    rng = np.random.default_rng(4)
    x = (np.ones((200, 8)) + 0.05 * rng.normal(size=(200, 8))).astype(np.float32)
    got = {(r.doc_id, r.other_id) for r in most_similar(wide(spark, x), 5, 0.9).collect()}
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    assert got == {(i, int(j)) for i in range(200) for j in np.argsort(-c[i])[:5]}


def test_clusters_of_unequal_size_with_strays(spark):
    rng = np.random.default_rng(2)
    centres = np.linalg.qr(rng.normal(size=(64, 64)))[0][:6]
    sizes = [2000, 900, 400, 150, 80, 60]
    noise = lambda n: rng.normal(size=(n, 64)) / 8
    x = np.concatenate([c + noise(n) for c, n in zip(centres, sizes)] + [noise(200)]).astype(np.float32)
    truth = np.repeat(np.arange(7), [*sizes, 200])
    z = [(i, int(10 + truth[i]) if rng.random() < 0.6 else int(rng.integers(0, 40)) if rng.random() < 0.7 else None, -1) for i in range(0, len(x), 2)] + [(None, 1, 1), (1, -1, 0)]
    topics = spark.createDataFrame(z, "doc_id long, z_hat int, cluster int")
    records, table = clusters(wide(spark, x, extra=dirty(64)), topics)
    table = {r.cluster: r for r in table.collect()}
    assert len(table) == 6 and sorted(r.z_cluster for r in table.values()) == list(range(10, 16))
    rows = records.collect()
    right = sum(table[r.cluster].z_cluster - 10 == truth[r.doc_id] for r in rows)
    assert right == len(rows) and len(rows) > 0.97 * sum(sizes) and sum(t.size for t in table.values()) == len(rows)
    assert typical(records, 3).count() == 18
    empty, none = clusters(wide(spark, x[:0]), topics.limit(0))
    assert empty.count() == 0 and none.count() == 0


def test_tight_clusters_are_told_from_copies_by_number(spark):
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(64, 64)))[0][:4]
    spread, sizes = [0.045, 0.005, 0.09, 0.01], [600, 1500, 900, 12]  # members of cosine 0.94, 1.0 and 0.8 to their mean; copies of one record
    x = np.concatenate([c + s * rng.normal(size=(n, 64)) for c, s, n in zip(centres, spread, sizes)] + [rng.normal(size=(150, 64))]).astype(np.float32)
    truth = np.repeat(np.arange(5), [*sizes, 150])
    order = rng.permutation(len(x))
    topics = spark.createDataFrame([(i, int(truth[j])) for i, j in enumerate(order)], "doc_id long, z_hat int")
    records, table = clusters(wide(spark, x[order]), topics)
    assert sorted((r.z_cluster, r.size) for r in table.collect()) == [(0, 600), (1, 1500), (2, 900)]
    assert {r.doc_id for r in records.collect()} == set(np.flatnonzero(truth[order] < 3).tolist())


def test_small_cluster_among_any_number_of_strays(spark):
    """14 alike vectors are a cluster of 12 or more, beside 6,000 strays as beside 30,000."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30_014, 64)).astype(np.float32)
    x[:14] = x[0] + 0.1 * rng.normal(size=(14, 64))
    for n in (6_014, len(x)):
        rows = pa.table({"doc_id": np.arange(n)} | {f"dim_{k + 1}": x[:n, k] for k in range(64)})
        centres, sizes = fit(unit_blocks(spark.createDataFrame(rows)), 64, 0.42, 12)
        best = (centres @ x[0] / np.linalg.norm(x[0])).max(initial=-1)
        assert best > 0.9 and sizes.min() >= 12, (n, best, sizes)
