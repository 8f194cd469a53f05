"""Queries on accidents as sets of topics, networks, scenarios, splits, spans, logs and contrastive batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import l2_normalised
from ..operators import chunking, contrastive, network, splits
from .registry import query
from .tables import PREDICTIONS, UNIT_VECTORS, UNITS, VECTORS, embedded, labelled, predictions, rounded, table, units

LEAST, PER_MACRO, SURE = 5, 6, 0.5
CHAIN = ["M_A0", "M_A1", "M_B", "severity_high"]


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).where("z_hat >= 0")
    return p.select("doc_id", "accident_id", "z_hat", "z_confidence", F.col("z_dominant_macro").alias("macro"), F.col("pred_severity").alias("severity"))


def _support(spark: SparkSession, sf: str) -> DataFrame:
    return network.topic_support(_rows(spark, sf), SURE)


def _accidents(spark: SparkSession, sf: str) -> int:
    return _rows(spark, sf).where("accident_id is not null").agg(F.count_distinct("accident_id")).first()[0]


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    return network.selected_topics(_support(spark, sf), _accidents(spark, sf), PER_MACRO, LEAST)


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return network.accident_matrix(_rows(spark, sf), _selected(spark, sf), SURE)


def _nodes(matrix: DataFrame) -> list[str]:
    return sorted(c for c in matrix.columns if c.startswith(("Z_", "M_")) or c == "severity_high")


RANKED = "greatest(coalesce(list_position(['NONE','MINOR','HOSPITALIZED','FATAL'], upper(trim(pred_severity))) - 1, 0), 0)"
NET = f"""{PREDICTIONS}, un as (select doc_id, accident_id, z_hat, z_confidence, z_dominant_macro macro, pred_severity from predictions where z_hat >= 0),
 mc as (select z_hat, macro, count(*) n from un where accident_id is not null and macro is not null group by 1, 2), mm as (select z_hat, macro from mc qualify row_number() over (partition by z_hat order by n desc, macro) = 1),
 sp as (select z_hat, count(distinct accident_id) s from un where accident_id is not null and z_confidence >= {SURE} and not isnan(z_confidence) group by 1), su as (select mm.z_hat, macro, coalesce(s, 0) support from mm left join sp using (z_hat)),
 se as (select z_hat, macro, support, printf('Z_%02d_%s', z_hat, macro) variable, support / (select count(distinct accident_id) from un where accident_id is not null) share from su where support >= {LEAST} qualify row_number() over (partition by macro order by support desc, z_hat) <= {PER_MACRO}),
 sv as (select accident_id, max({RANKED})::int severity_ord from un where accident_id is not null group by 1),
 al as (select distinct accident_id, variable from un join se using (z_hat) where accident_id is not null and z_confidence >= {SURE} and not isnan(z_confidence)),
 mp as (select sv.accident_id, (sv.severity_ord >= 2)::int severity_high, max((variable like '%_A0')::int) a0, max((variable like '%_A1')::int) a1, max((variable like '%_B')::int) b, max((variable like '%_C')::int) c from sv left join al using (accident_id) group by all),
 mx as (select accident_id, severity_high, coalesce(a0, 0) "M_A0", coalesce(a1, 0) "M_A1", coalesce(b, 0) "M_B", coalesce(c, 0) "M_C" from mp)"""


@query(f"with {NET} select z_hat, macro, support from su")
def topic_support(spark: SparkSession, sf: str) -> DataFrame:
    return _support(spark, sf)


@query(f"with {NET} select z_hat, macro, support, variable, round(share, 6) share from se")
def selected_topics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_selected(spark, sf))


@query(f"with {NET} select accident_id, variable from al")
def accident_matrix_long(spark: SparkSession, sf: str) -> DataFrame:
    return network.accident_long(_rows(spark, sf), _selected(spark, sf), SURE)


@query()
def accident_matrix_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Columns follow the data; the long form and the macros are checked by SQL."""
    return _matrix(spark, sf)


@query(f"with {NET} select accident_id, severity_high, \"M_A0\", \"M_A1\", \"M_B\" from mx")
def macro_presence(spark: SparkSession, sf: str) -> DataFrame:
    return _chain(spark, sf)


@query(f"with {NET} select accident_id, severity_ord, ['NONE','MINOR','HOSPITALIZED','FATAL'][severity_ord + 1] severity_label from sv")
def severity_by_accident(spark: SparkSession, sf: str) -> DataFrame:
    return network.severity_by_accident(_rows(spark, sf))


SCEN = """vl as (select sv.accident_id, (severity_ord >= 2)::int h, coalesce(string_agg(variable, '+' order by variable), '') scenario from sv left join al using (accident_id) group by 1, 2),
 sc as (select scenario, count(*) support, avg(h) p from vl group by 1), tp as (select * from sc order by support desc, scenario limit 30), fr as (select * from tp where support >= 5 order by support desc, scenario limit 10)"""
PATH = "array_to_string(list_filter(['A0','A1','B','C'], lambda m: len(list_filter(string_split(scenario, '+'), lambda v: v like '%\\_' || m escape '\\')) > 0), '>')"


@query(f"with {NET}, {SCEN} select scenario, support, round(p, 6) p_severity_high, {PATH} macro_path from fr")
def scenarios_frequent(spark: SparkSession, sf: str) -> DataFrame:
    m = _matrix(spark, sf)
    return rounded(network.scenarios(m, [c for c in m.columns if c.startswith("Z_")]))


@query(f"with {NET}, {SCEN} select scenario, support, round(p, 6) p_severity_high, {PATH} macro_path from fr order by p desc, support desc, scenario limit 5")
def scenarios_severe(spark: SparkSession, sf: str) -> DataFrame:
    m = _matrix(spark, sf)
    return rounded(network.severe(network.scenarios(m, [c for c in m.columns if c.startswith("Z_")])))


@query(
    f"""with {NET}, {SCEN}, tg as (select doc_id, any_value(sentence) sentence from data_metallurgie where doc_id is not null and sentence is not null group by 1),
    fa as (select accident_id, scenario from vl where scenario in (select scenario from fr) qualify row_number() over (partition by scenario order by accident_id) <= 5)
    select scenario, accident_id, doc_id, left(sentence, 200) sentence from un join tg using (doc_id) join fa using (accident_id) qualify row_number() over (partition by scenario, accident_id order by doc_id) <= 2"""
)
def scenario_examples(spark: SparkSession, sf: str) -> DataFrame:
    m = _matrix(spark, sf)
    v = [c for c in m.columns if c.startswith("Z_")]
    s = table(spark, sf, "data_metallurgie").where("doc_id is not null and sentence is not null").groupBy("doc_id").agg(F.min("sentence").alias("sentence"))
    return network.examples(m, v, network.scenarios(m, v), _rows(spark, sf).select("doc_id", "accident_id").join(s, "doc_id"))


def _ranks(spark: SparkSession, sf: str) -> dict[str, str]:
    return {r.variable: r.macro for r in _selected(spark, sf).collect()} | {"Severity_high": "Severity"}


@query(
    f"""with {NET}, nd as (select variable v, list_position(['A0','A1','B','C'], macro) - 1 r from se union all select 'Severity_high', 4)
    select p.v parent, c.v child from nd p, nd c where p.v <> c.v and (p.r = 4 or (c.r <> 4 and p.r > c.r))"""
)
def blacklist(spark: SparkSession, sf: str) -> DataFrame:
    return network.forbidden(spark, _ranks(spark, sf))


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    m = _matrix(spark, sf)
    for c in CHAIN:
        if c not in m.columns:
            m = m.withColumn(c, F.lit(0))
    from ..session import cut

    return cut(m.select("accident_id", *CHAIN))


CPD = """cp as (select 'M_A0' node, '' given, s.s, ((select count(*) from mx where "M_A0" = s.s) + 2.5) / ((select count(*) from mx) + 5) p from (select unnest([0, 1]) s) s
 union all select 'M_A1', g.g::varchar, s.s, ((select count(*) from mx where "M_A0" = g.g and "M_A1" = s.s) + 1.25) / ((select count(*) from mx where "M_A0" = g.g) + 2.5) from (select unnest([0, 1]) s) s, (select unnest([0, 1]) g) g
 union all select 'M_B', g.g::varchar, s.s, ((select count(*) from mx where "M_A1" = g.g and "M_B" = s.s) + 1.25) / ((select count(*) from mx where "M_A1" = g.g) + 2.5) from (select unnest([0, 1]) s) s, (select unnest([0, 1]) g) g
 union all select 'severity_high', g.g::varchar, s.s, ((select count(*) from mx where "M_B" = g.g and severity_high = s.s) + 1.25) / ((select count(*) from mx where "M_B" = g.g) + 2.5) from (select unnest([0, 1]) s) s, (select unnest([0, 1]) g) g)"""


@query(f"with {NET}, {CPD} select node, given, s state, round(p, 6) p from cp")
def cpd_macro_chain(spark: SparkSession, sf: str) -> DataFrame:
    m, out = _chain(spark, sf), None
    for i, node in enumerate(CHAIN):
        t = network.conditional_table(m, node, CHAIN[i - 1 : i] if i else [])
        t = t.select(F.lit(node).alias("node"), (F.col(CHAIN[i - 1]).cast("string") if i else F.lit("")).alias("given"), F.col(node).alias("state"), "p")
        out = t if out is None else out.unionByName(t)
    return rounded(out)


@query(
    f"""with {NET}, {CPD}, a as (select p from cp where node = 'M_A0' and s = 1), b as (select sum(cp.p * case when given = '1' then a.p else 1 - a.p end) p from cp, a where node = 'M_A1' and s = 1),
    c as (select sum(cp.p * case when given = '1' then b.p else 1 - b.p end) p from cp, b where node = 'M_B' and s = 1), d as (select sum(cp.p * case when given = '1' then c.p else 1 - c.p end) p from cp, c where node = 'severity_high' and s = 1)
    select 'M_A0' node, round(p, 6) p1 from a union all select 'M_A1', round(p, 6) from b union all select 'M_B', round(p, 6) from c union all select 'severity_high', round(p, 6) from d"""
)
def chain_marginals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(network.chain_marginals(_chain(spark, sf), CHAIN))


@query(
    f"""with {NET}, e as (select unnest([('M_A0', 'M_A1'), ('M_A1', 'M_B'), ('M_B', 'severity_high')]) e), w as (unpivot mx on "M_A0", "M_A1", "M_B", severity_high into name n value x),
    f as (select e[1] parent, e[2] child, avg(c.x) pc, sum(p.x * c.x) / nullif(sum(p.x), 0) pcp, sum(p.x) np, sum(c.x) nc from e join w p on p.n = e[1] join w c on c.n = e[2] and c.accident_id = p.accident_id group by 1, 2)
    select parent, child, round(pc, 6) p_child, round(pcp, 6) p_child_given_parent, round(pcp / pc, 6) lift from f where np > 0 and nc > 0"""
)
def arc_lift_empirical(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(network.lifts(_chain(spark, sf), list(zip(CHAIN, CHAIN[1:]))))


@query(f"with {NET}, {CPD} select node, s state, round(avg(p), 6) p from cp where node <> 'M_A0' group by 1, 2")
def cpd_marginals(spark: SparkSession, sf: str) -> DataFrame:
    m, out = _chain(spark, sf), None
    for a, b in zip(CHAIN, CHAIN[1:]):
        t = network.mean_over_parents(network.conditional_table(m, b, [a]), b).select(F.lit(b).alias("node"), "state", "p")
        out = t if out is None else out.unionByName(t)
    return rounded(out)


def _bic_sql(node: str, parents: list[str]) -> str:
    by = ", ".join(f'"{c}"' for c in [*parents, node])
    over = f"partition by {', '.join(chr(34) + p + chr(34) for p in parents)}" if parents else ""
    return f"select '{node}' node, '{','.join(parents)}' parents, round(sum(n * ln(n / s)) - 0.5 * ln(sum(n)) * {2 ** len(parents)}, 5) bic from (select n, sum(n) over ({over}) s from (select {by}, count(*)::double n from mx group by {by}))"


FAMILIES = [("M_A0", ()), ("M_A1", ()), ("M_A1", ("M_A0",)), ("M_B", ("M_A0", "M_A1")), ("severity_high", ("M_B",)), ("severity_high", ("M_A0", "M_B"))]


@query(f"with {NET} " + " union all ".join(_bic_sql(n, list(p)) for n, p in FAMILIES))
def bic_family_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(network.family_scores(_chain(spark, sf), FAMILIES), 5)


@query()
def hill_climb(spark: SparkSession, sf: str) -> DataFrame:
    m = _matrix(spark, sf)
    names = network.varying(m, [c for c in m.columns if c.startswith("Z_")] + ["severity_high"])[:12]
    ranks = {n: n.rsplit("_", 1)[-1] for n in names if n.startswith("Z_")} | {"severity_high": "Severity"}
    banned = {(r.parent, r.child) for r in network.forbidden(spark, {n: ranks[n] for n in names}).collect()}
    return spark.createDataFrame(network.hill_climb(m, names, banned, 2, 12), "parent string, child string")


@query("select true acyclic, 0 banned, true within_two_parents")
def hill_climb_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What every found structure must keep."""
    m = _matrix(spark, sf)
    names = network.varying(m, [c for c in m.columns if c.startswith("Z_")] + ["severity_high"])[:8]
    ranks = {n: n.rsplit("_", 1)[-1] for n in names if n.startswith("Z_")} | {"severity_high": "Severity"}
    banned = {(r.parent, r.child) for r in network.forbidden(spark, {n: ranks[n] for n in names}).collect()}
    e = network.hill_climb(m, names, banned, 2, 8)
    row = (network.acyclic(e), sum(x in banned for x in e), all(sum(c == n for _, c in e) <= 2 for n in names))
    return spark.createDataFrame([row], "acyclic boolean, banned int, within_two_parents boolean")


EDGES = [("M_A0", "M_A1"), ("M_A1", "M_B"), ("M_B", "M_C"), ("M_C", "severity_high"), ("M_A0", "severity_high")]
EDGE_SQL = "e as (select unnest([" + ", ".join(f"{{'parent': '{a}', 'child': '{b}'}}" for a, b in EDGES) + "], recursive := true))"


@query(f"with {EDGE_SQL}, d as (select n, sum(o) o, sum(i) i from (select parent n, 1 o, 0 i from e union all select child, 0, 1 from e) group by n) select count(*) n_nodes, sum(i)::bigint n_edges, max(i)::bigint max_in_degree, max(o)::bigint max_out_degree, count(*) filter (i = 0) n_roots, count(*) filter (o = 0) n_leaves, round(sum(i) / (count(*) * (count(*) - 1)), 6) density from d")
def edge_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(network.diagnostics(spark.createDataFrame(EDGES, "parent string, child string")))


@query(f"with {EDGE_SQL}, n as (select distinct unnest([parent, child]) v from e) select a.v parent, b.v child, (select count(*) from e where parent = a.v and child = b.v)::int present from n a, n b")
def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return network.adjacency(spark, sorted({x for e in EDGES for x in e}), spark.createDataFrame(EDGES, "parent string, child string"))


# correlation, splits, folds, logs ---------------------------------------------------------------------------------------------


@query(f"""with {NET} select 'M_A0' x, 'M_A1' y, round(corr("M_A0", "M_A1"), 6) corr from mx union all select 'M_A0', 'M_B', round(corr("M_A0", "M_B"), 6) from mx union all select 'M_A0', 'severity_high', round(corr("M_A0", severity_high), 6) from mx
 union all select 'M_A1', 'M_B', round(corr("M_A1", "M_B"), 6) from mx union all select 'M_A1', 'severity_high', round(corr("M_A1", severity_high), 6) from mx union all select 'M_B', 'severity_high', round(corr("M_B", severity_high), 6) from mx""")
def binary_correlation(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.agreement import correlation

    return rounded(correlation(_chain(spark, sf), CHAIN))


@query()
def group_kfold(spark: SparkSession, sf: str) -> DataFrame:
    f = splits.group_folds(units(spark, sf), "accident_id", 5)
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("accident_id").alias("accidents"))


@query()
def hold_out(spark: SparkSession, sf: str) -> DataFrame:
    return splits.hold_out(units(spark, sf), "accident_id", 0.2).groupBy("is_validation").agg(F.count("*").alias("n"), F.count_distinct("accident_id").alias("accidents"))


@query(f"with {UNITS} select count(*) n, count(distinct accident_id) accidents, 0::bigint accidents_in_two_folds, 5::bigint folds from units")
def group_kfold_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every row in a fold, every group whole."""
    f = splits.group_folds(units(spark, sf), "accident_id", 5)
    torn = f.where("accident_id is not null").groupBy("accident_id").agg(F.count_distinct("fold").alias("k")).where("k > 1").agg(F.count("*").alias("accidents_in_two_folds"))
    return f.agg(F.count("*").alias("n"), F.count_distinct("accident_id").alias("accidents"), F.count_distinct("fold").alias("folds")).crossJoin(F.broadcast(torn))  # one row each


@query(f"with {UNITS}, g as (select count(distinct accident_id) n from units) select true is_validation, ceil(0.2 * n)::bigint accidents from g union all select false, (n - ceil(0.2 * n))::bigint from g")
def hold_out_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The number of groups held out."""
    return splits.hold_out(units(spark, sf), "accident_id", 0.2).groupBy("is_validation").agg(F.count_distinct("accident_id").alias("accidents"))


@query(f"with {UNITS} select pred_label, least(count(*), 100) n from units group by 1")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_sample(units(spark, sf), "pred_label", 400).groupBy("pred_label").agg(F.count("*").alias("n"))


FOLDS = "f as (select run_id::varchar fold_id, avg(z_confidence) confidence, count(*)::double n from pt_z_target where z_confidence is not null and not isnan(z_confidence) and run_id is not null group by 1)"


def _folds(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pt_z_target").where(F.col("z_confidence").isNotNull() & ~F.isnan("z_confidence") & F.col("run_id").isNotNull())
    return t.groupBy(F.col("run_id").alias("fold_id")).agg(F.avg("z_confidence").alias("confidence"), F.count("*").cast("double").alias("n"))


@query(f"with {FOLDS} select 'confidence' metric, round(avg(confidence), 6) mean, round(coalesce(stddev_samp(confidence), 0), 6) std, count(*) n from f union all select 'n', round(avg(n), 6), round(coalesce(stddev_samp(n), 0), 6), count(*) from f")
def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(splits.fold_summary(_folds(spark, sf), ["confidence", "n"]))


@query(f"with {FOLDS} select fold_id, 'confidence' metric, round(confidence, 6) \"value\" from f union all select fold_id, 'n', round(n, 6) from f")
def metrics_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(splits.unpivoted(_folds(spark, sf), "fold_id", ["confidence", "n"]))


@query(f"with {FOLDS} select fold_id method, round(confidence, 6) confidence, row_number() over (order by confidence desc nulls last, fold_id)::int place from f")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(splits.leaderboard(_folds(spark, sf).select(F.col("fold_id").alias("method"), "confidence"), "confidence"))


@query(f"with e as (select run_id, z_hat epoch, avg(z_confidence) m from pt_z_target where z_hat >= 0 and run_id is not null and z_confidence is not null and not isnan(z_confidence) group by 1, 2) select run_id, epoch, round(m, 6) m from e qualify row_number() over (partition by run_id order by round(m, 9) desc, epoch) = 1")
def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pt_z_target").where(F.col("z_confidence").isNotNull() & ~F.isnan("z_confidence") & F.col("run_id").isNotNull() & (F.col("z_hat") >= 0))
    log = t.groupBy("run_id", F.col("z_hat").alias("epoch")).agg(F.round(F.avg("z_confidence"), 9).alias("m"))
    return rounded(splits.best_epoch(log, "run_id", metric="m").select("run_id", "epoch", "m"))


@query("select a, b, c from (select unnest([0.1, 0.2]) a), (select unnest([16, 32, 64]) b), (select unnest(['x', 'y']) c)")
def grid_expand(spark: SparkSession, sf: str) -> DataFrame:
    return splits.grid_frame(spark, {"a": [0.1, 0.2], "b": [16, 32, 64], "c": ["x", "y"]}).select("a", F.col("b").cast("int").alias("b"), "c")


# spans and tokens ---------------------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").alias("t"))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    s = _texts(spark, sf).select("doc_id", F.posexplode(F.split("t", r"\.")).alias("span", "s"), "t")
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    a = F.coalesce(F.sum(F.length("s") + 1).over(w), F.lit(0)).cast("int")
    return s.withColumn("a", a).withColumn("b", F.col("a") + F.length("s")).where("b > a").select("doc_id", "span", "a", "b")


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = _texts(spark, sf).select("doc_id", F.posexplode(F.split("t", " ")).alias("token", "s"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    x = F.coalesce(F.sum(F.length("s") + 1).over(w), F.lit(0)).cast("int")
    return t.withColumn("x", x).withColumn("y", F.col("x") + F.length("s")).where("y > x").select("doc_id", "token", "x", "y")


SPANS = """tx as (select doc_id, text t from documents where text is not null),
 sp as (select * from (select doc_id, i - 1 span, s, (coalesce(sum(len(s) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0))::int a from (select doc_id, unnest(string_split(t, '.')) s, generate_subscripts(string_split(t, '.'), 1) i from tx)) where len(s) > 0),
 tk as (select * from (select doc_id, i - 1 token, s, (coalesce(sum(len(s) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0))::int x from (select doc_id, unnest(string_split(t, ' ')) s, generate_subscripts(string_split(t, ' '), 1) i from tx)) where len(s) > 0)"""


@query(f"with {SPANS} select sp.doc_id, span, count(*) n_tokens, min(token)::int first, max(token)::int last from sp join tk on sp.doc_id = tk.doc_id and x < a + len(sp.s) and x + len(tk.s) > a group by 1, 2")
def span_token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    j = chunking.span_tokens(_spans(spark, sf), _tokens(spark, sf))
    return j.groupBy("doc_id", "span").agg(F.count("*").alias("n_tokens"), F.min("token").alias("first"), F.max("token").alias("last"))


@query(f"with {SPANS}, g as (select sp.doc_id, span, count(tk.doc_id) n from sp left join tk on sp.doc_id = tk.doc_id and x < a + len(sp.s) and x + len(tk.s) > a group by 1, 2) select doc_id, count(*) n_sentences, count(*) filter (n > 0) n_embedded, round(count(*) filter (n > 0) / count(*), 6) coverage_sentences, round(coalesce(avg(n) filter (n > 0), 0), 6) avg_tokens_per_sentence from g group by 1")
def chunk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    s = _spans(spark, sf)
    return rounded(chunking.coverage(s, chunking.span_tokens(s, _tokens(spark, sf))))


@query("select doc_id, n_chars n, greatest(ceil((n_chars - 510) / 446.0), 0)::int + 1 n_windows from documents where n_chars > 0")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("n_chars > 0")
    return d.select("doc_id", F.col("n_chars").alias("n"), F.size(chunking.window_bounds(F.col("n_chars"), 510, 64)).alias("n_windows"))


# contrastive batches: 16 vectors by number, as the reference batches rows -----------------------------------------------------------


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    v = embedded(labelled(spark, sf).drop("macro_id"))
    return v.select((F.col("doc_id") / 16).cast("long").alias("batch"), "doc_id", "label", l2_normalised(F.col("embedding")).alias("embedding"))


PAIRS = f"""{UNITS}, {VECTORS}, {UNIT_VECTORS}, bt as (select doc_id // 16 batch, doc_id, pred_label l, u from units join unit_vectors using (doc_id)),
 pr as (select a.batch, a.doc_id i, a.l = b.l positive, list_distance(a.u, b.u) d from bt a join bt b on a.batch = b.batch and a.doc_id <> b.doc_id)"""


@query(f"with {PAIRS}, z as (select batch, i, ln(sum(exp(-d * d / 0.1))) z, avg(-d * d / 0.1) filter (positive) p from pr group by 1, 2) select batch, round(-avg(p - z), 5) loss from z where p is not null group by 1")
def supcon_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(contrastive.supcon(contrastive.batch_pairs(_batches(spark, sf))), 5)


@query(f"with {PAIRS}, h as (select batch, i, max(d) filter (positive) p, min(d) filter (not positive) n from pr group by 1, 2) select batch, round(avg(greatest(p - n + 0.5, 0)), 5) loss from h where p is not null and n is not null group by 1")
def triplet_hard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(contrastive.triplet_hard(contrastive.batch_pairs(_batches(spark, sf))), 5)
