import math

import pytest
from pyspark.sql import functions as F

from fabula.functions import scalars as S
from fabula.functions import text as T
from fabula.operators import agreement, chunking, network, quality, splits
from fabula.sources import readers, sinks


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_scalars(spark):
    df = spark.createDataFrame([(" TRUE ",), ("1",), ("1.0",), ("faux",), (None,)], "c string")
    assert [r.x for r in df.select(S.tolerant_bool(F.col("c")).alias("x")).collect()] == [True, True, False, False, False]
    assert one(spark, S.macro_code(F.lit("B"))) == 2 and one(spark, S.macro_code(F.lit("b"))) is None and one(spark, S.macro_code(F.lit("b"), -1)) == -1
    assert one(spark, S.argmax(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)))) == 1
    assert one(spark, S.softmax(F.array(F.lit(0.0), F.lit(0.0)))) == [0.5, 0.5]
    assert one(spark, S.one_hot(F.lit(1), 3)) == [0, 1, 0]
    assert one(spark, S.severity_rank(F.lit("Fatal"))) == 3 and one(spark, S.severity_rank(F.lit(None).cast("string"))) == 0 and one(spark, S.severity_name(F.lit(9))) == "FATAL"
    assert one(spark, S.topic_variable(F.lit(7), F.lit("A1"))) == "Z_07_A1" and one(spark, S.topic_of_variable(F.lit("Z_07_A1"))) == 7
    assert one(spark, S.outlier_topic(F.lit("A0_-1"))) and not one(spark, S.outlier_topic(F.lit("1")))
    assert one(spark, S.bar(F.lit(0.25), 10)) == "██" + "░" * 8
    assert one(spark, S.cosine_rate(1.0, F.lit(5), 10)) == pytest.approx(0.5)


def test_text(spark):
    assert one(spark, T.clean(F.lit("L'eau,  VIVE !"))) == "leau vive"
    assert one(spark, T.clean_spaced(F.lit("L'eau n°3"))) == "l eau n 3"
    assert one(spark, T.tokens(F.lit("Été abc1 l'eau x"))) == ["été", "eau"]
    assert one(spark, T.packed_sentences(F.lit("a ||  b||"), 5)) == ["a", "b"]
    assert one(spark, T.slug(F.lit("Éléments d'œuvre (2)"))) == "elements_d_uvre_2"
    assert one(spark, T.fallback_label(F.array().cast("array<string>"))) == "-"
    assert one(spark, T.embedded_json(F.lit('ok {"a": 1} !'), "a int")).a == 1
    assert one(spark, T.clamped_label(F.array(*map(F.lit, "abcdef")), ["x"], 2, 4)) == "a b c d…"
    found = one(spark, T.spans(F.lit("ab. ab. c"), F.array(F.lit("ab."), F.lit("ab."), F.lit("z"), F.lit("c"))))
    assert [(s.start, s.end) for s in found] == [(0, 3), (4, 7), (-1, -1), (8, 9)]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "A0", "1"), (2, "Z", "1"), (3, "B", "no"), (None, "B", "1")], "doc_id long, pred_label string, pred_ok string")
    assert [r.doc_id for r in readers.labelled_units(df).collect()] == [1]
    v = spark.createDataFrame([(1, 1.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 0.0, 0.0), (1, 1.0, 0.0)], "doc_id long, dim_0 float, dim_1 float")
    assert [r.doc_id for r in readers.usable_vectors(v).collect()] == [1]
    with pytest.raises(ValueError):
        readers.join_vectors(df.where("doc_id is not null"), readers.usable_vectors(v))
    with pytest.raises(ValueError):
        readers.required(df, ["sentence"])
    with pytest.raises(FileNotFoundError):
        readers.check_files(str(tmp_path), ["a.csv"])
    keyed = readers.with_key(spark.createDataFrame([(x,) for x in "dbca"], "t string"), ["t"])
    assert {r.t: r.doc_id for r in keyed.collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "metrics.csv").write_text("delta_macro_pct,c1\n12.5,0.3\n")
    rows = readers.metric_rows(spark, {"m": str(tmp_path / "m"), "none": str(tmp_path / "none")}).collect()
    assert len(rows) == 1 and rows[0].eta2_macro_balanced_perc == 12.5 and rows[0].rankme_global is None
    (tmp_path / "stop.txt").write_text("# words\nLe\n\nla\n")
    assert readers.stop_words(str(tmp_path / "stop.txt")) == ["la", "le"]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "x.csv").write_text("doc_id,dim_1\n1,2\n")
    assert readers.find_vectors(str(tmp_path)).endswith("x.csv")
    protos = spark.createDataFrame([(0, [1.0, 0.0])], "id int, vec array<double>")
    (tmp_path / "model").mkdir()
    sinks.write_model({"mu": protos}, {"k": 1}, str(tmp_path / "model"))
    tables, params = readers.read_model(spark, str(tmp_path / "model"))
    assert params == {"k": 1} and tables["mu"].first().vec == [1.0, 0.0]
    assert sinks.markdown(spark.createDataFrame([("a|b", 0.5)], "n string, v double")).splitlines()[2] == "| a\\|b | 0.5000 |"
    assert "probability ( B | A )" in sinks.bif_text({"A": ["0", "1"], "B": ["0", "1"]}, [("A", [], {(): [0.5, 0.5]}), ("B", ["A"], {(0,): [0.9, 0.1], (1,): [0.2, 0.8]})])


def test_network(spark):
    assert network.acyclic([("a", "b"), ("b", "c")]) and not network.acyclic([("a", "b"), ("b", "a")])
    assert network.break_cycles([("a", "b"), ("b", "c"), ("c", "a")]) == [("a", "b"), ("b", "c")]
    rows = [(i, int(i % 2), int(i % 2 if i % 10 else 1 - i % 2), int(i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "accident_id long, a int, b int, c int")
    edges = network.hill_climb(df, ["a", "b", "c"])
    assert {frozenset(e) for e in edges} == {frozenset(("a", "b"))}
    t = {(r.a, r.b): r.p for r in network.conditional_table(df, "b", ["a"], 0.0).collect()}
    assert t[1, 1] == pytest.approx(1.0) and t[0, 0] == pytest.approx(0.8)
    m = {r.node: r.p1 for r in network.chain_marginals(df, ["a", "b"], 0.0).collect()}
    assert m["b"] == pytest.approx(0.6)
    banned = network.forbidden(spark, {"Z_00_A0": "A0", "Z_01_C": "C", "S": "Severity"}).collect()
    assert {(r.parent, r.child) for r in banned} == {("Z_01_C", "Z_00_A0"), ("S", "Z_00_A0"), ("S", "Z_01_C")}
    assert network.lifts(df, []).count() == 0


def test_accidents_without_confident_units_stay(spark):
    u = spark.createDataFrame([("x", 1, 0.9, "A0", "FATAL"), ("y", 1, None, "A0", None), ("z", None, 0.9, None, "minor")], "accident_id string, z_hat int, z_confidence double, macro string, severity string")
    sel = network.selected_topics(network.topic_support(u), 3, 6, 1)
    m = {r.accident_id: r for r in network.accident_matrix(u, sel).collect()}
    assert len(m) == 3 and m["x"].Z_01_A0 == 1 and m["y"].Z_01_A0 == 0 and m["z"].severity_ord == 1 and m["x"].M_A0 == 1
    s = network.scenarios(network.accident_matrix(u, sel), ["Z_01_A0"], least=1).collect()
    assert [(r.scenario, r.support) for r in s] == [("", 2), ("Z_01_A0", 1)]


def test_splits_and_logs(spark):
    df = spark.createDataFrame([(i, f"g{i // 4}") for i in range(80)] + [(99, None)], "doc_id long, g string")
    f = splits.group_folds(df, "g", 4)
    assert f.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty() and f.count() == 81
    h = splits.hold_out(df, "g", 0.25)
    assert h.where("is_validation").select("g").distinct().count() == 5
    s = {r.metric: r for r in splits.fold_summary(spark.createDataFrame([("1", "x"), ("3", "2")], "a string, b string"), ["a", "b"]).collect()}
    assert s["a"].std == pytest.approx(math.sqrt(2)) and s["b"].std == 0.0 and s["b"].n == 1
    log = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, 2.0)], "epoch int, eta2_perc double")
    assert splits.best_epoch(log).first().epoch == 1
    assert len(splits.grid({"t.lr": [0.1, 0.2], "t.bs": [1, 2]})) == 4


def test_agreement_and_quality(spark):
    df = spark.createDataFrame([("A0", "A0")] * 3 + [("A1", "A0"), ("A1", "A1"), (None, "B")], "t string, g string")
    r = agreement.classification(df, "t", "g").first()
    assert r.n == 5 and r.accuracy == pytest.approx(0.8) and r.balanced_accuracy == pytest.approx(0.75)
    same = agreement.nmi_ari(df.where("t = g"), "t", "g").first()
    assert same.nmi == pytest.approx(1) and same.ari == pytest.approx(1)
    t = spark.createDataFrame([("0", ["a", "b"], 3), ("1", ["b", "c"], 5), ("-1", ["z"], 9)], "id string, words array<string>, n_docs long")
    q = quality.quality_row(t, 16, 2).first()
    assert q.n_topics == 2 and q.coverage == 0.5 and q.topic_diversity == 0.75 and q.mean_pairwise_jaccard == pytest.approx(1 / 3)


def test_spans(spark):
    s = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 101)], "doc_id long, span int, a int, b int")
    t = spark.createDataFrame([(1, k, 10 * k, 10 * k + 5) for k in range(12)], "doc_id long, token int, x int, y int")
    got = {(r.span, r.token) for r in chunking.span_tokens(s, t, 16).collect()}
    assert got == {(0, k) for k in range(10)} | {(1, 10)}
    assert [(w.start, w.end) for w in one(spark, chunking.window_bounds(F.lit(20), 8, 2))] == [(0, 8), (6, 14), (12, 20)]
