import numpy as np
import pytest

from fabula.operators import agreement, geometry, posterior
from fabula.sources import readers


def wide(spark, x, labels):
    d = x.shape[1]
    rows = [(i, l, *map(float, v)) for i, (v, l) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "doc_id long, label string, " + ", ".join(f"dim_{k} double" for k in range(d)))


def by_numpy(x, labels):
    labels = np.array(labels)
    ok = [c for c in ("A0", "A1", "B", "C") if (labels == c).sum() >= 2]
    known = np.isin(labels, ["A0", "A1", "B", "C"])
    means = {c: x[labels == c].mean(0) for c in ok}
    w = {c: ((x[labels == c] - means[c]) ** 2).sum(1).mean() for c in ok}
    mb = np.mean(list(means.values()), axis=0)
    tb = np.mean([((x[labels == c] - mb) ** 2).sum(1).mean() for c in ok])
    mw = x[known].mean(0)
    tw = ((x[known] - mw) ** 2).sum(1).mean()
    ww = sum((labels == c).sum() * w[c] for c in ok) / known.sum()
    return tb, np.mean(list(w.values())), tw, ww


def test_separated_classes_and_singleton(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(20, 8)) * 0.3 + 3 * np.eye(8)[k] for k in range(3)] + [rng.normal(size=(1, 8)), rng.normal(size=(4, 8))])
    labels = ["A0"] * 20 + ["A1"] * 20 + ["B"] * 20 + ["C"] + ["?"] * 4
    r = geometry.eta2(wide(spark, x, labels)).first()
    tb, wb, tw, ww = by_numpy(x, labels)
    assert np.allclose([r.T_balanced, r.W_balanced, r.T_weighted, r.W_weighted], [tb, wb, tw, ww], atol=1e-9)
    assert r.B_balanced == pytest.approx(r.T_balanced - r.W_balanced, abs=1e-9)
    assert r.eta2_macro_balanced > 0.5 and r.eta2_weighted > 0.3
    assert r.macros_ignored == "C" and r.W_C is None and r.n_C == 1 and r.n == 61


def test_random_labels_equal_vectors_and_too_few(spark):
    rng = np.random.default_rng(1)
    r = geometry.eta2(wide(spark, rng.normal(size=(80, 16)), ["A0", "A1", "B", "C"] * 20)).first()
    assert r.eta2_macro_balanced < 0.15 and r.eta2_weighted < 0.15
    r = geometry.eta2(wide(spark, np.ones((10, 4)), ["A0", "A1"] * 5)).first()
    assert r.eta2_macro_balanced is None
    r = geometry.eta2(wide(spark, np.ones((1, 4)), ["A0"])).first()
    assert r.n == 0 and r.T_balanced is None
    r = geometry.eta2(wide(spark, np.ones((1, 4)), ["?"])).first()
    assert r.n == 0


def test_spectrum_equals_svd(spark):
    x = np.random.default_rng(2).normal(size=(40, 6)) * np.array([5, 3, 1, 1, 0.5, 0.1])
    r = geometry.spectrum(wide(spark, x, ["A0"] * 40)).first()
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    p = s / s.sum()
    assert r.rankme == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-8)
    assert r.c1 == pytest.approx(s[0] ** 2 / (s**2).sum(), rel=1e-8)
    assert geometry.spectrum(wide(spark, np.ones((3, 2)), ["A0"] * 3)).first().rankme is None


def test_posteriors_sum_to_one_and_one_hot_score(spark):
    rng = np.random.default_rng(3)
    v = wide(spark, rng.normal(size=(20, 5)), ["A0", "A1", "B", "C"] * 5)
    arr = readers.as_array(v)
    protos = posterior.prototypes(arr, "label")
    rows = posterior.scored(arr, protos, 0.1).collect()
    assert len(rows) == 20 and all(abs(sum(r.p) - 1) < 1e-9 for r in rows) and rows[0].p_ids == ["A0", "A1", "B", "C"]


def test_balanced_assignment(spark):
    s = np.random.default_rng(4).random((400, 6)) + 0.1
    plan = posterior.balance_step(s)
    assert np.allclose(plan.sum(1), 1 / 400, atol=1e-6)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(s)], "doc_id long, s array<double>")
    z = posterior.sinkhorn(df)
    assert z.count() == 400 and z.select("z_hat").distinct().count() == 6
    assert posterior.sinkhorn(df.limit(0)).count() == 0


def test_silhouette(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 3))
    k = np.array([0, 1, 2] * 10)
    df = spark.createDataFrame([(i, [float(a) for a in v], str(c)) for i, (v, c) in enumerate(zip(x, k))], "doc_id long, embedding array<double>, label string")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(30):
        a = d[i, k == k[i]].sum() / 9
        b = min(d[i, k == c].mean() for c in range(3) if c != k[i])
        want.append((b - a) / max(a, b))
    assert agreement.silhouette(df, "label", block=7).first().silhouette == pytest.approx(np.mean(want), abs=1e-9)
    assert agreement.silhouette(df, "label", 8).first().n == 8
    assert agreement.silhouette(df.where("label = '0'"), "label").first().silhouette is None
