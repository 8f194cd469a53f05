"""Queries on vectors: geometry, posteriors, transfer, clustering quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import MACROS, argmax, entropy
from ..operators import geometry, posterior
from .registry import query
from .tables import PREDICTIONS, UNIT_VECTORS, UNITS, VECTORS, embedded, labelled, predictions, rounded, vectors

# long form of labelled vectors and their sums, for the checks
LONG = f"{UNITS}, {VECTORS}, lv as (select doc_id, pred_label c, v from units join vectors using (doc_id)), l as (select doc_id, c, unnest(v) x, generate_subscripts(v, 1) i from lv)"
ETA = """
cd as (select c, i, sum(x) s, sum(x * x) q, count(*)::double n from l group by c, i),
cls as (select c, any_value(n) n, case when any_value(n) >= 2 then sum(q / n - (s / n) * (s / n)) end w from cd group by c),
ok as (select cd.*, s / n m from cd where n >= 2),
mb as (select i, avg(m) m from ok group by i),
mw as (select i, sum(s) / sum(n) m, sum(q) q, sum(n) n from cd group by i),
tb as (select avg(t) t from (select ok.c, sum(ok.q / ok.n - 2 * mb.m * ok.m + mb.m * mb.m) t from ok join mb using (i) group by ok.c)),
tw as (select sum(q / n - m * m) t, any_value(n) n from mw),
wb as (select avg(w) w from cls where n >= 2), ww as (select sum(n * w) / (select sum(n) from cls) w from cls where n >= 2),
eta as (select (select n from tw)::bigint n, (select t from tb) tbal, (select w from wb) wbal, (select t from tw) twei, (select w from ww) wwei)"""
ETA_OUT = """select n, round(tbal, 6) "T_balanced", round(wbal, 6) "W_balanced", round(tbal - wbal, 6) "B_balanced", round(least(greatest(1 - wbal / (tbal + 1e-12), 0), 1), 6) eta2_macro_balanced,
 round(100 * least(greatest(1 - wbal / (tbal + 1e-12), 0), 1), 6) eta2_macro_balanced_perc, round(twei, 6) "T_weighted", round(wwei, 6) "W_weighted", round(twei - wwei, 6) "B_weighted",
 round(least(greatest(1 - wwei / (twei + 1e-12), 0), 1), 6) eta2_weighted,
 round((select w from cls where c = 'A0'), 6) "W_A0", round((select w from cls where c = 'A1'), 6) "W_A1", round((select w from cls where c = 'B'), 6) "W_B", round((select w from cls where c = 'C'), 6) "W_C",
 coalesce((select n from cls where c = 'A0'), 0)::bigint "n_A0", coalesce((select n from cls where c = 'A1'), 0)::bigint "n_A1", coalesce((select n from cls where c = 'B'), 0)::bigint "n_B", coalesce((select n from cls where c = 'C'), 0)::bigint "n_C",
 coalesce((select string_agg(c, ',' order by c) from cls where n = 1), '') macros_ignored from eta"""


@query(f"with {LONG}, {ETA} {ETA_OUT}")
def eta2_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geometry.eta2(labelled(spark, sf)))


@query(f"with {UNITS}, {VECTORS}, {UNIT_VECTORS}, l as (select doc_id, pred_label c, unnest(u) x, generate_subscripts(u, 1) i from units join unit_vectors using (doc_id)), {ETA} {ETA_OUT}")
def eta2_l2norm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geometry.eta2(geometry.normalised(labelled(spark, sf))))


@query(f"with {LONG} select c label, i::int pos, count(*) n, round(avg(x), 6) x from l group by c, i")
def class_centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = geometry.centroids(labelled(spark, sf))
    return rounded(c.select("label", "n", F.posexplode("vec").alias("pos", "x")).withColumn("pos", F.col("pos") + 1))


@query()
def rankme_pca(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geometry.spectrum(labelled(spark, sf)).unionByName(geometry.spectrum(labelled(spark, sf), "label").drop("label")))


@query()
def rankme_by_macro(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geometry.spectrum(labelled(spark, sf), "label"))


@query()
def metric_row(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geometry.metric_row(labelled(spark, sf), "qwen3", "btp"))


@query()
def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: the signs of components are free."""
    return geometry.projection(labelled(spark, sf)).select("doc_id", F.abs(F.round(F.get("pc", F.lit(0)), 5)).alias("pc1"), F.abs(F.round(F.get("pc", F.lit(1)), 5)).alias("pc2"))


@query(
    f"""with {LONG}, {ETA.split('mb as')[0].rstrip().rstrip(',')}, f as (select l.c, l.doc_id, sqrt(sum((l.x - ok.m) * (l.x - ok.m))) r from l join (select c, i, s / n m from cd) ok using (c, i) group by 1, 2),
    r as (select c, avg(r) r from f group by c),
    g as (select a.c a, b.c b, sqrt(sum((a.s / a.n - b.s / b.n) * (a.s / a.n - b.s / b.n))) g from cd a join cd b using (i) where a.c <> b.c group by 1, 2),
    db as (select avg(v) v from (select a, max((ra.r + rb.r) / g) v from g join r ra on ra.c = a join r rb on rb.c = b group by a)),
    t as (select sum(q) q, sum(s * s / n) b from cd), m as (select sum(ss * ss / nn) mm from (select i, sum(s) ss, sum(n) nn from cd group by i)),
    k as (select count(distinct c) k, (select count(distinct doc_id) from l) n from cd)
    select n, k, round(((b - mm) / (k - 1)) / ((q - b) / (n - k)), 6) calinski_harabasz, round(v, 6) davies_bouldin from t, m, k, db"""
)
def davies_bouldin(spark: SparkSession, sf: str) -> DataFrame:
    """davies_bouldin and calinski_harabasz of the labels."""
    return rounded(geometry.davies_bouldin_and_calinski(labelled(spark, sf)))


@query(
    f"""with {UNITS}, {VECTORS}, lv as (select doc_id, pred_label c, v from units join vectors using (doc_id)), n as (select c, count(*) n from lv group by 1),
    s as (select a.doc_id, a.c own, b.c, sum(list_distance(a.v, b.v)) s from lv a, lv b group by 1, 2, 3),
    m as (select doc_id, max(case when own = s.c then s / (n - 1) end) a, min(case when own <> s.c then s / n end) b from s join n on n.c = s.c group by 1)
    select count(*) n, round(avg((b - a) / greatest(a, b)), 6) silhouette from m"""
)
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    """A36; SQL takes all vectors as queries, which holds up to 10,000 of them."""
    from ..operators.agreement import silhouette as of

    return rounded(of(embedded(labelled(spark, sf).drop("macro_id")), "label"))


# posteriors: labels from the source corpus, topics from the target corpus -------------------------------------------------


def _held(prototypes: DataFrame) -> DataFrame:
    """Prototypes, a row a label or topic, computed once for all their uses in a query."""
    return prototypes.sparkSession.createDataFrame(prototypes.collect(), prototypes.schema)


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return _held(posterior.prototypes(embedded(labelled(spark, sf).drop("macro_id")), "label"))


def _topic_rows(spark: SparkSession, sf: str) -> DataFrame:
    z = predictions(spark, sf).where("z_hat >= 0").select("doc_id", "z_hat", "pred_label")
    return embedded(vectors(spark, sf).drop("corpus").join(z, "doc_id"))


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return _held(posterior.prototypes(_topic_rows(spark, sf), "z_hat"))


MU = f"""{UNITS}, {VECTORS}, {UNIT_VECTORS}, {PREDICTIONS},
 yl as (select pred_label id, unnest(u) x, generate_subscripts(u, 1) i from units join unit_vectors using (doc_id)),
 ym as (select id, list(m order by i) m from (select id, i, avg(x) m from yl group by id, i) group by id),
 mu_y as (select id, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) vec from ym),
 tr as (select doc_id, z_hat, pred_label, u from predictions join unit_vectors using (doc_id) where z_hat >= 0),
 zl as (select z_hat id, unnest(u) x, generate_subscripts(u, 1) i from tr),
 zm as (select id, list(m order by i) m from (select id, i, avg(x) m from zl group by id, i) group by id),
 mu_z as (select id, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) vec from zm),
 zx0 as (select doc_id, mu_z.id z, list_inner_product(u, vec) / 0.1 s from tr, mu_z),
 zx as (select doc_id, z, exp(s - max(s) over (partition by doc_id)) / sum(exp(s - m)) over (partition by doc_id) p from (select *, max(s) over (partition by doc_id) m from zx0)),
 yz0 as (select z.id z, y.id y, list_inner_product(z.vec, y.vec) s from mu_z z, mu_y y),
 yz as (select z, y, exp(s) / sum(exp(s)) over (partition by z) q from yz0)"""


def _zx(spark: SparkSession, sf: str) -> DataFrame:
    return posterior.scored(_topic_rows(spark, sf), _topics(spark, sf), 0.1)


def _yz(spark: SparkSession, sf: str) -> DataFrame:
    return _held(posterior.topic_labels(_topics(spark, sf), _labels(spark, sf)))


@query(f"with {MU} select doc_id, arg_max(z, (round(p, 9), -z))::int z_hat, round(max(p), 5) z_confidence from zx group by doc_id")
def posterior_zx(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_zx(spark, sf).select("doc_id", F.get("p_ids", argmax(F.transform("p", lambda x: F.round(x, 9)))).alias("z_hat"), F.array_max("p").alias("z_confidence")), 5)


@query(f"with {MU} select z z_id, y macro, round(q, 6) p from yz")
def posterior_yz(spark: SparkSession, sf: str) -> DataFrame:
    q = _yz(spark, sf).select(F.col("id").alias("z_id"), F.explode(F.arrays_zip("q_ids", "q")).alias("t"))
    return rounded(q.select("z_id", F.col("t.q_ids").alias("macro"), F.col("t.q").alias("p")))


@query(f"with {MU} select doc_id, y macro, round(sum(p * q), 6) p from zx join yz using (z) group by doc_id, y")
def posterior_yx(spark: SparkSession, sf: str) -> DataFrame:
    topics = _topics(spark, sf)
    y = posterior.scored(_topic_rows(spark, sf), topics, 0.1, yz=posterior.topic_labels(topics, _labels(spark, sf)))
    rows = y.select("doc_id", F.explode(F.arrays_zip("y_ids", "y")).alias("t"))
    return rounded(rows.select("doc_id", F.col("t.y_ids").alias("macro"), F.col("t.y").alias("p")))


@query(f"with {MU}, e as (select doc_id, -sum(p * ln(greatest(p, 1e-12))) h, max(p) m from zx group by doc_id) select count(*) n, round(avg(h), 5) mean_entropy, round(min(h), 5) min_entropy, round(max(h), 5) max_entropy, round(avg(m), 5) mean_confidence from e")
def posterior_entropy(spark: SparkSession, sf: str) -> DataFrame:
    h = _zx(spark, sf).select(entropy(F.col("p")).alias("h"), F.array_max("p").alias("m"))
    return rounded(h.agg(F.count("*").alias("n"), F.avg("h").alias("mean_entropy"), F.min("h").alias("min_entropy"), F.max("h").alias("max_entropy"), F.avg("m").alias("mean_confidence")), 5)


@query(f"with {PREDICTIONS}, c as (select z_hat, count(*) n from predictions where z_hat is not null group by 1), s as (select n / sum(n) over () s from c) select count(*) n_active, round(sum(-s * ln(s)), 6) usage_entropy, round(max(s), 6) max_mass from s")
def cluster_usage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.usage(predictions(spark, sf)))


@query(
    f"""with {MU}, n as (select z_hat z, count(*) n from predictions group by 1), p as (pivot yz on y in ('A0','A1','B','C') using sum(q) group by z)
    select p.z z_id, round(p."A0", 6) "p_A0", round(p."A1", 6) "p_A1", round(p."B", 6) "p_B", round(p."C", 6) "p_C", (select arg_max(y, (q, y < 'A1', y < 'B', y < 'C')) from yz where yz.z = p.z) dominant_macro, coalesce(n, 0) n_units from p left join n on n.z = p.z"""
)
def z_affiliation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.affiliation(_topics(spark, sf), _yz(spark, sf), predictions(spark, sf)))


P0 = """p00 as (select doc_id, y.id y, list_inner_product(u, y.vec) / 0.1 s from tr, mu_y y),
 p0 as (select doc_id, y, exp(s - m) / sum(exp(s - m)) over (partition by doc_id) p from (select *, max(s) over (partition by doc_id) m from p00))"""


@query(f"with {MU}, {P0}, c as (select p0.doc_id, yz.z, sum(p0.p * ln(greatest(q, 1e-8))) c from p0 join yz using (y) group by 1, 2) select doc_id, round(max(exp(ln(greatest(zx.p, 1e-8)) + c)), 5) best_score, round(sum(exp(ln(greatest(zx.p, 1e-8)) + c)), 5) total_score from zx join c using (doc_id, z) group by doc_id")
def malt_scores(spark: SparkSession, sf: str) -> DataFrame:
    """E-step scores of soft labels."""
    rows = posterior.scored(_zx(spark, sf), _labels(spark, sf), 0.1, "p0")
    t = _yz(spark, sf).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "q"))), lambda s: s["q"]).alias("qs"))
    s = rows.crossJoin(F.broadcast(t)).select("doc_id", posterior.em_score(F.col("p"), F.col("p0"), F.col("qs")).alias("s"))  # a single row
    return rounded(s.select("doc_id", F.array_max("s").alias("best_score"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("total_score")), 5)


@query(
    f"""with {MU}, b as (select doc_id, arg_max(z, (round(p, 9), -z)) z, max(p) p, -sum(p * ln(greatest(p, 1e-12))) h from zx group by doc_id)
    select round(avg(-ln(greatest(b.p, 1e-12))), 5) ls1, round(avg(-ln(greatest(q, 1e-12))), 5) ls2, round(avg(h), 5) mean_entropy from b join tr using (doc_id) join yz on yz.z = b.z and yz.y = tr.pred_label where tr.pred_label in ('A0','A1','B','C')"""
)
def scgm_losses(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scalars import macro_code

    rows = _zx(spark, sf).withColumn("macro_id", macro_code(F.col("pred_label"))).withColumn("p", F.transform("p", lambda x: x))
    return rounded(posterior.assignment_losses(rows, _yz(spark, sf)), 5)


@query(
    f"""with {MU}, {P0}, c as (select p0.doc_id, yz.z, sum(p0.p * ln(greatest(q, 1e-8))) c from p0 join yz using (y) group by 1, 2),
    pt as (select doc_id, y, sum(p * q) p from zx join yz using (z) group by 1, 2),
    r as (select doc_id, arg_max(z, (round(p, 9), -z)) z, max(p) p from zx group by 1),
    a as (select avg(-ln(greatest(r.p, 1e-8))) em_z, avg(-c) em_yz from r join c on c.doc_id = r.doc_id and c.z = r.z),
    m as (select doc_id, max(p0.p) w, -sum(p0.p * ln(greatest(pt.p, 1e-8))) x from p0 join pt using (doc_id, y) group by 1),
    g as (select z, avg(p) x from zx group by 1)
    select round(em_z, 5) em_z, round(em_yz, 5) em_yz, round(em_z + em_yz, 5) em, round((select sum(w * x) / sum(w) from m), 5) macro, round((select avg(-ln(greatest(x, 1e-12))) - ln(count(*)) from g), 5) balance from a"""
)
def malt_losses(spark: SparkSession, sf: str) -> DataFrame:
    topics, labels = _topics(spark, sf), _labels(spark, sf)
    return rounded(posterior.transfer_sums(_topic_rows(spark, sf), topics, labels, _held(posterior.topic_labels(topics, labels))), 5)


@query(
    f"""with {MU}, y as (select doc_id, y, sum(p * q) p from zx join yz using (z) group by 1, 2)
    select round(avg(-ln(greatest(p, 1e-12))), 5) ls3 from y join tr using (doc_id) where y.y = tr.pred_label"""
)
def scgm_macro_loss(spark: SparkSession, sf: str) -> DataFrame:
    """M20, the label term."""
    from ..functions.scalars import macro_code

    topics = _topics(spark, sf)
    y = posterior.scored(_topic_rows(spark, sf), topics, 0.1, yz=posterior.topic_labels(topics, _labels(spark, sf)))
    return rounded(posterior.macro_loss(y.withColumn("macro_id", macro_code(F.col("pred_label")))), 5)


@query(
    f"""with {MU}, tl as (select pred_label id, unnest(u) x, generate_subscripts(u, 1) i from tr where pred_label in ('A0','A1','B','C')), tm as (select id, list(m order by i) m from (select id, i, avg(x) m from tl group by 1, 2) group by id),
    d as (select y.id macro, y.vec a, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) b from mu_y y join tm on tm.id = y.id)
    select macro, round(list_distance(a, b), 6) drift, round(list_inner_product(a, b), 6) cosine from d"""
)
def anchor_drift(spark: SparkSession, sf: str) -> DataFrame:
    """A32."""
    from ..functions.scalars import dot

    target = posterior.prototypes(_topic_rows(spark, sf).where(F.col("pred_label").isin(*MACROS)), "pred_label")
    j = _labels(spark, sf).join(target.select("id", F.col("vec").alias("b")), "id")
    gap = F.sqrt(F.aggregate(F.zip_with("vec", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return rounded(j.select(F.col("id").alias("macro"), gap.alias("drift"), dot(F.col("vec"), F.col("b")).alias("cosine")))


@query(f"with {MU} select round(avg(exp(list_inner_product(a.vec, b.vec))), 6) diversity from mu_z a join mu_z b on a.id <> b.id")
def diversity_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(posterior.diversity_loss(_topics(spark, sf)))


@query()
def sinkhorn_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced assignment of the target corpus to its topics: size of each."""
    z = posterior.sinkhorn(_zx(spark, sf).select("doc_id", F.col("p").alias("s")))
    return z.groupBy("z_hat").agg(F.count("*").alias("n"))


@query(
    f"""with {MU}, s1 as (select z id, i, sum(p * u[i]) x from zx join tr using (doc_id), (select unnest(range(1, 65)) i) group by 1, 2),
    n1 as (select id, i, x / sqrt(sum(x * x) over (partition by id)) x from s1) select id, i::int pos, round(x, 4) x from n1"""
)
def prototype_em(spark: SparkSession, sf: str) -> DataFrame:
    """One round of E and M, all dimensions."""
    at = posterior.prototype_em(_topic_rows(spark, sf), _topics(spark, sf), 1)
    return at.select("id", F.posexplode("vec").alias("pos", "x")).select("id", (F.col("pos") + 1).alias("pos"), F.round("x", 4).alias("x"))


@query()
def prototype_em_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds with balanced assignment."""
    at = posterior.prototype_em(_topic_rows(spark, sf), _topics(spark, sf), 3, balanced=True)
    return at.select("id", F.posexplode("vec").alias("pos", "x"))


@query(f"with {MU}, k as (select count(distinct z)::double k from zx) select true balanced, k::int topics from k")
def sinkhorn_residual(spark: SparkSession, sf: str) -> DataFrame:
    """How far the plan is from balance: under a hundredth of the mass."""
    from ..session import cut

    rows = cut(_zx(spark, sf).select("doc_id", F.col("p").alias("s")))
    g, residual = posterior.balanced_factors(rows, 25.0, 0.01, 100)
    return spark.createDataFrame([(residual <= 0.01, len(g))], "balanced boolean, topics int")


@query()
def kmeans_topics(spark: SparkSession, sf: str) -> DataFrame:
    k = posterior.kmeans_topics(embedded(labelled(spark, sf)), "label", 4)
    return k.groupBy("label", "cluster").agg(F.count("*").alias("n"), F.round(1 / (1 + F.avg("distance")), 6).alias("confidence"))
