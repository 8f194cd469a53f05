import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm.balanced_sample import cube_sample, flight
from fabula.llm.linked_splits import accident_components, linked_splits, split_leaks
from fabula.llm.top_n import LoserTree, Run, merge_top, top_n

DAY = dt.datetime(2024, 1, 1)


def test_loser_tree_merges():
    rng = random.Random(0)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(6))) for _ in range(k)]
        at, out = [0] * k, []
        tree = LoserTree([(r[0],) if r else None for r in runs])
        while (h := tree.heads[w := tree.winner()]) is not None:
            out.append(h[0])
            at[w] += 1
            tree.replay(w, (runs[w][at[w]],) if at[w] < len(runs[w]) else None)
        assert out == sorted(x for r in runs for x in r)
    assert list(merge_top([], 3)) == [] and list(merge_top([Run(*(np.array([], t) for t in (int, float, int)))], 3)) == []


def test_top_n(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        run = "hot" if i % 3 else rng.choice(["a", "b", None])
        rows.append((run, rng.choice([*range(400), None]), rng.choice([0, 1, 2, -1, None]), rng.choice([0.5, 0.5, 0.9, rng.random(), None, float("nan"), float("inf")]), rng.choice([None, DAY, DAY + dt.timedelta(days=rng.randrange(3))]), 1))
    rows += rows[:100]
    df = spark.createDataFrame(rows, "run_id string, doc_id long, z_hat int, z_confidence double, scored_at timestamp, bucket int")
    low = dt.datetime(1, 1, 1)
    last = {}
    for run, d, z, s, at, _ in rows:
        if run is None or d is None:
            continue
        s = None if s is None or s != s else s
        key = (at or low, -1.0 if s is None else s, -9 if z is None else z)
        if (run, d) not in last or key > last[run, d][0]:
            last[run, d] = (key, z, s)
    groups = {}
    for (run, d), (_, z, s) in last.items():
        if z is not None and s is not None:
            groups.setdefault((run, z), []).append((-s, d))
    want = {(*g, d, i + 1) for g, v in groups.items() for i, (_, d) in enumerate(sorted(v)[:5])}
    assert {(r.run_id, r.z_hat, r.doc_id, r.place) for r in top_n(df, 5).collect()} == want
    assert top_n(df.limit(0), 5).count() == 0


def accidents(spark):
    rows = [(i, ["ACC-%09d", "acc %09d ", "%09d", "ACC_%09d"][i % 4] % (i // 5), ["train", "test", None][(i // 5) % 3], [" A0", "B", None, "a1"][i % 4], "x") for i in range(400)]
    rows += [(900, None, "train", "A0", "x"), (901, "??", "test", "C", "x"), (None, "ACC-000000001", "train", "A0", "x")] + rows[:9]
    return spark.createDataFrame(rows, "doc_id long, accident_id string, split_name string, pred_label string, component string")


LINKS = "accident_id_a string, accident_id_b string, link_reason string"


def test_splits_keep_components(spark):
    links = spark.createDataFrame([("ACC-000000001", "ACC-000000002", None), ("acc 000000002", "ACC-000000900", "x"), ("ACC-000000900", "000000011", "x"), (None, "ACC-000000003", "x"), ("ACC-000000004", "ACC-000000004", "x")], LINKS)
    assert {r.accident_id for r in split_leaks(accidents(spark), links).collect()} == {f"ACC-{i:09d}" for i in (1, 2, 11)}
    assert accident_components(links).select("component").distinct().count() == 1
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.3)], "split_name string, target_share double")
    out = linked_splits(accidents(spark), links, targets)
    assert out.count() == 402 and out.groupBy("component").agg(F.count_distinct("split_name").alias("n")).where("n > 1").isEmpty()
    share = {r.split_name: r["count"] / 402 for r in out.groupBy("split_name").count().collect()}
    assert abs(share["train"] - 0.8) < 0.06
    empty = accidents(spark).limit(0)
    assert split_leaks(empty, links.limit(0)).count() == 0 and linked_splits(empty, links, targets).count() == 0 and linked_splits(accidents(spark), links, targets.limit(0)).count() == 0


def test_flight_keeps_the_sum_and_the_means():
    rng = np.random.default_rng(2)
    taken = np.zeros(7)
    for _ in range(4000):
        p = np.array([0.5, 0.5, 0.25, 0.75, 1.0, 0.0, 0.3])
        q, left = flight(p, lambda at, turn: rng.random(len(at)))
        assert q.sum() == pytest.approx(p.sum()) and ((q > 0) & (q < 1)).sum() == (left >= 0) <= 1
        taken += q
    assert np.allclose(taken / 4000, [0.5, 0.5, 0.25, 0.75, 1, 0, 0.3], atol=0.03)


def test_sample_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["A0", " a0 ", "A0", "B", "C", None, "nan"]), rng.choice(["True", " yes ", "1", "no", None, "1.0"]), "k") for i in range(3000)]
    rows += rows[:300] + [(None, "A0", "1", "k")]
    df = spark.createDataFrame(rows, "doc_id long, pred_label string, pred_ok string, plan_id string")
    t = spark.createDataFrame([(1, "A0", 0.5, 10, 200), (1, "B", 0.25, 80, 200), (1, "C", 0.2, 0, 100_000), (1, "D", 0.05, 5, 200), (2, "B", None, None, 100), (None, "A0", 0.1, 1, 10)], "plan_id int, pred_label string, target_share double, min_rows long, sample_rows long")
    sample, report = cube_sample(df, t)
    rep = {(r.plan_id, r.pred_label): r for r in report.collect()}
    assert rep[1, "A0"].drawn == 100 and rep[1, "B"].drawn == 80 and rep[1, "C"].drawn == rep[1, "C"].eligible and rep[1, "C"].short > 0
    assert rep[1, "D"].short == 10 and rep[2, "B"].wanted == 0 and all(r.residual == 0 for r in rep.values())
    assert sample.dropDuplicates().count() == sample.count()
    ok = {i for i, label, flag, _ in rows if label and label.strip().upper() == "A0" and flag and flag.strip().lower() in ("true", "1", "yes", "t")}
    assert {r.doc_id for r in sample.where("plan_id = 1 and pred_label = 'A0'").collect()} <= ok
    s, r = cube_sample(df.limit(0), t)
    assert s.count() == 0 and r.where("drawn > 0").count() == 0 and cube_sample(df, t.limit(0))[0].count() == 0
