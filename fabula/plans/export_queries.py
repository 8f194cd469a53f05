"""Queries on prediction exports, aligned topic tables, network inference and comparison, projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MACROS
from ..operators import exports, geometry, network
from .network_queries import CHAIN, CPD, EDGES, EDGE_SQL, FOLDS, NET, _chain, _folds
from .registry import query
from .tables import PREDICTIONS, UNITS, VECTORS, embedded, labelled, predictions, rounded, table

FOUR = ["p_a0_given_z", "p_a1_given_z", "p_b_given_z", "p_c_given_z"]
WHOLE = " and ".join(f"{c} is not null and not isnan({c})" for c in FOUR)
SHARES = f"sh as (select doc_id, z_hat, [{', '.join(FOUR)}] p from predictions where {WHOLE}), yz as (select z_hat z_id, " + ", ".join(f"avg({c}) q{i}" for i, c in enumerate(FOUR)) + f" from predictions where {WHOLE} and z_hat is not null group by 1)"


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).where(WHOLE)


def _matrix(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.array(*FOUR).alias("p"))


def _yz(rows: DataFrame) -> DataFrame:
    return rows.where("z_hat is not null").groupBy(F.col("z_hat").alias("z_id")).agg(F.array(*[F.round(F.avg(c), 9) for c in FOUR]).alias("q"))


@query(
    f"""with {PREDICTIONS}, {SHARES} select doc_id, {", ".join(f'round(p[{i + 1}], 6) "pt_{m}"' for i, m in enumerate(MACROS))}, (list_position(p, list_max(p)) - 1)::int pt_macro_id,
    ['A0','A1','B','C'][list_position(p, list_max(p))] pt_macro_name, (list_position(p, list_max(p)) - 1)::int z_hat, round(list_max(p), 6) z_confidence from sh"""
)
def derived_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns rebuilt from matrices aligned by key."""
    rows = _shares(spark, sf)
    m = _matrix(rows)
    return rounded(exports.derived(rows.select("doc_id"), pt=m, pz=m))


@query(
    f"""with {PREDICTIONS}, {SHARES}, r as (select z_id, [round(q0, 9), round(q1, 9), round(q2, 9), round(q3, 9)] q from yz) select doc_id, sh.z_hat, {", ".join(f'round(q[{i + 1}], 6) "p_{m}_given_z"' for i, m in enumerate(MACROS))},
    ['A0','A1','B','C'][list_position(q, list_max(q))] z_dominant_macro from sh left join r on z_id = sh.z_hat"""
)
def label_shares(spark: SparkSession, sf: str) -> DataFrame:
    """P24."""
    rows = _shares(spark, sf)
    return rounded(exports.label_shares(rows.select("doc_id", "z_hat"), _yz(rows)))


THEMES = "th as (select * from themes_by_z where run_id is not null and z_id is not null)"


def _themes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "themes_by_z").where("run_id is not null and z_id is not null")


@query(f"with {PREDICTIONS}, {THEMES}, s as (select z_id, min(top_words) w from th where trim(top_words) <> '' group by 1) select z_hat z_id, count(*) n_units, coalesce(any_value(w), '-') theme_summary from predictions left join s on z_id = z_hat where z_hat is not null group by 1")
def topics_with_themes(spark: SparkSession, sf: str) -> DataFrame:
    """J5, J6."""
    themes = _themes(spark, sf).where("trim(top_words) <> ''").groupBy("z_id").agg(F.min("top_words").alias("theme_summary"))
    topics = predictions(spark, sf).where("z_hat is not null").groupBy(F.col("z_hat").alias("z_id")).agg(F.count("*").alias("n_units"))
    return exports.with_themes(topics, themes)


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return _themes(spark, sf).select(F.col("run_id").alias("method"), F.col("dominant_macro").alias("macro"), F.col("z_id").alias("topic_id"), F.col("n_units").alias("n_docs"), "top_words", "top_sentences")


@query(f"with {THEMES} select run_id method, " + ", ".join(f"count(*) filter (dominant_macro = '{m}') \"{m}\"" for m in MACROS) + " from th group by 1")
def macro_topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A12."""
    return exports.macro_counts(_topics(spark, sf))


@query(
    f"""with {THEMES}, q as (select dominant_macro macro, run_id "method", (row_number() over (partition by dominant_macro, run_id order by n_units desc, z_id))::int place, z_id topic_id, n_units n_docs, top_words,
    list_filter(list_transform(regexp_split_to_array(coalesce(top_sentences, ''), '\\s*\\|\\|\\s*'), lambda s: trim(s)), lambda s: s <> '') s from th where dominant_macro in ('A0','A1','B','C'))
    select macro, "method", place, topic_id, n_docs, top_words, coalesce(s[1], '') top_sentence_1, coalesce(s[2], '') top_sentence_2, coalesce(s[3], '') top_sentence_3 from q"""
)
def qualitative_topics(spark: SparkSession, sf: str) -> DataFrame:
    """M17."""
    return exports.qualitative(_topics(spark, sf))


@query(f"with {FOLDS} select fold_id, round(confidence, 6) confidence, n from f")
def fold_test_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """P21."""
    f = _folds(spark, sf).select("fold_id", F.col("confidence").alias("test_confidence"), F.col("n").alias("test_n"), F.lit(0.0).alias("train_n"))
    return rounded(exports.test_metrics(f, ["confidence", "n", "rankme"]))


@query(f"with {FOLDS} select fold_id, round(confidence, 6) val_confidence, n val_n, null::double val_rankme from f")
def val_metric_columns(spark: SparkSession, sf: str) -> DataFrame:
    """P22."""
    return rounded(exports.val_columns(_folds(spark, sf), ["confidence", "n", "rankme"]))


@query("select * from (values ('Delta_Macro_Pct ', 'eta2_macro_balanced_perc'), ('rankme', 'rankme_global'), ('c10', 'c10')) t(name, metric), (values ('euclidean')) d(distance)")
def metric_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """H21."""
    t = spark.createDataFrame([("Delta_Macro_Pct ",), ("rankme",), ("c10",)], "name string")
    return t.select("name", exports.metric_name(F.col("name")).alias("metric"), F.lit(exports.distance_name(" Eucledian")).alias("distance"))


# networks ------------------------------------------------------------------------------------------------------------------

PARENTS = {c: CHAIN[i - 1 : i] for i, c in enumerate(CHAIN)}
CHAINED = f"""{NET}, {CPD}, j as (select a.s a, b.s b, c.s c, d.s d, a.p * b.p * c.p * d.p p from cp a, cp b, cp c, cp d
 where a.node = 'M_A0' and b.node = 'M_A1' and b.given = a.s::varchar and c.node = 'M_B' and c.given = b.s::varchar and d.node = 'severity_high' and d.given = c.s::varchar)"""


@query(f"with {CHAINED}, m as (select 'M_A0' node, a state, p from j union all select 'M_A1', b, p from j union all select 'M_B', c, p from j union all select 'severity_high', d, p from j) select node, state::int state, round(sum(p), 6) p from m group by 1, 2")
def network_marginals(spark: SparkSession, sf: str) -> DataFrame:
    """G7 by variable elimination, against the sum over the whole joint table."""
    t = network.network_tables(_chain(spark, sf), PARENTS)
    return rounded(spark.createDataFrame(network.marginals(t), "node string, state int, p double"))


@query(f"with {CHAINED} select a::int given_a0, c::int given_b, d::int severity_high, round(sum(p) / (select sum(p) from j k where k.a = j.a and k.c = j.c), 6) p from j group by a, c, d")
def network_conditionals(spark: SparkSession, sf: str) -> DataFrame:
    """G7 with evidence on two nodes."""
    t = network.network_tables(_chain(spark, sf), PARENTS)
    rows = [(a, b, s, float(network.infer(t, ["severity_high"], {"M_A0": a, "M_B": b})[s])) for a in (0, 1) for b in (0, 1) for s in (0, 1)]
    return rounded(spark.createDataFrame(rows, "given_a0 int, given_b int, severity_high int, p double"))


WITH_CYCLES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "b"), ("e", "f")]


@query("select * from (values ('a', 'b'), ('b', 'c'), ('c', 'd'), ('e', 'f')) t(parent, child)")
def edges_without_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """C-a and d-b close the cycles."""
    return spark.createDataFrame(network.break_cycles(WITH_CYCLES), "parent string, child string")


@query(
    f"""with recursive {EDGE_SQL}, n as (select unnest(['M_A0','M_A1','M_B','M_C','severity_high','alone']) v), u as (select parent a, child b from e union select child, parent from e),
    r as (select v a, v b from n union select r.a, u.b from r join u on r.b = u.a), w as (select a, min(b) c from r group by 1), d as (select v, count(parent) i from n left join e on child = v group by 1),
    up as (select parent a, child b from e union select up.a, e.child from up join e on up.b = e.parent)
    select 'net' model_name, 6 n_nodes, (select count(*) from e)::int n_edges, not exists (select 1 from up where a = b) acyclic, (select max(i) from d)::int max_indegree, round(2 * (select count(*) from e) / 6, 6) mean_degree,
    (select count(distinct c) from w)::int n_weakly_connected, 1 n_isolated, 'alone' isolated_nodes"""
)
def network_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """G10."""
    return rounded(network.model_diagnostics(spark, "net", sorted({x for e in EDGES for x in e}) + ["alone"], EDGES))


BACKWARD = [*EDGES, ("M_C", "M_A0")]
RANKS = {"M_A0": "A0", "M_A1": "A1", "M_B": "B", "M_C": "C", "severity_high": "Severity"}


@query("select 'forward' structure, 5 n_arcs, 5 n_nodes, 0 macro_order_violations, 0.25::double density, 0 n_isolated union all select 'backward', 6, 5, 1, 0.3, 0")
def structure_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Arcs against the order of macros."""
    return rounded(network.structure_row(spark, "forward", RANKS, EDGES).unionByName(network.structure_row(spark, "backward", RANKS, BACKWARD)))


@query("select 'M_C' parent, 'M_A0' child")
def arc_violations(spark: SparkSession, sf: str) -> DataFrame:
    """J15."""
    return network.violations(spark.createDataFrame(BACKWARD, "parent string, child string"), network.forbidden(spark, RANKS))


@query("select * from (values ('M_A0', 'M_A1'), ('M_A1', 'M_B'), ('M_B', 'M_C'), ('M_C', 'severity_high'), ('M_A0', 'severity_high')) t(parent, child)")
def edges_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """J14, G4."""
    banned = {(r.parent, r.child) for r in network.forbidden(spark, RANKS).collect()}
    return spark.createDataFrame(network.pruned(BACKWARD, banned), "parent string, child string")


# projections ----------------------------------------------------------------------------------------------------------------

OUT = 8
W1 = np.array([[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(64)] for i in range(OUT)])
B1 = np.arange(OUT) / 10
LAYER = f"lay as (select i, j, ((7 * i + 3 * j) % 11 - 5) / 10.0::double w from (select unnest(range({OUT})) i), (select unnest(range(64)) j))"
PROJECTED = f"{UNITS}, {VECTORS}, {LAYER}, lv as (select doc_id, pred_label c, v from units join vectors using (doc_id)), l as (select doc_id, any_value(c) c, sum(v[j + 1] * w) + i / 10.0::double x, i from lv, lay group by doc_id, i)"


def _labelled_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return embedded(labelled(spark, sf).drop("macro_id"))


@query(f"with {PROJECTED} select doc_id, i::int pos, round(x, 5) x from l")
def projected_linear(spark: SparkSession, sf: str) -> DataFrame:
    """M23 with one layer."""
    p = exports.projected(_labelled_arrays(spark, sf), "linear", [(W1, B1)])
    return rounded(p.select("doc_id", F.posexplode("embedding").alias("pos", "x")), 5)


@query(f"with {PROJECTED} select doc_id, round(sum(greatest(x, 0)), 5) x from l group by 1")
def projected_mlp(spark: SparkSession, sf: str) -> DataFrame:
    """M23 with two layers, the first rectified, the second a sum."""
    p = exports.projected(_labelled_arrays(spark, sf), "mlp", [(W1, B1), (np.ones((1, OUT)), np.zeros(1))])
    return rounded(p.select("doc_id", F.get("embedding", F.lit(0)).alias("x")), 5)


def _projected_sql() -> str:
    from .vector_queries import ETA

    return f"with {PROJECTED}, {ETA} select 'linear' \"method\", 'btp' corpus, n, round(least(greatest(1 - wbal / (tbal + 1e-12), 0), 1), 5) eta2_macro_balanced, round(least(greatest(1 - wwei / (twei + 1e-12), 0), 1), 5) eta2_weighted from eta"


@query(_projected_sql())
def projected_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus through a projection and its metrics."""
    m = exports.projected_metrics(_labelled_arrays(spark, sf), OUT, "linear", "btp", "linear", [(W1, B1)])
    return rounded(m.select("method", "corpus", "n", "eta2_macro_balanced", "eta2_weighted"), 5)


@query("with t as (select doc_id, n_chars::double c from documents where n_chars is not null) select doc_id, round((c + c / 2) / 2, 6) mean_0, round((1 + 3) / 2.0, 6)::double mean_1, c cls_0 from t")
def pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over unmasked tokens, first token."""
    d = table(spark, sf, "documents").where("n_chars is not null").select("doc_id", F.col("n_chars").cast("double").alias("c"))
    v = F.array(F.array("c", F.lit(1.0)), F.array(F.col("c") / 2, F.lit(3.0)), F.array(F.lit(9.0), F.lit(9.0)))
    m = exports.mean_pool(v, F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)), 2)
    return rounded(d.select("doc_id", F.get(m, F.lit(0)).alias("mean_0"), F.get(m, F.lit(1)).alias("mean_1"), F.get(exports.cls_pool(v), F.lit(0)).alias("cls_0")))
