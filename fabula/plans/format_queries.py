"""Queries on formats and codecs: cleaned texts, slugs, variable names, bars, labels, wide vectors, model lifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import contrastive, geometry, network, splits
from ..sources import readers, sinks
from .network_queries import CHAIN, CPD, NET, _chain
from .registry import query
from .tables import PREDICTIONS, UNIT_VECTORS, UNITS, VECTORS, embedded, labelled, predictions, rounded, table, vectors

PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


@query(
    f"""select doc_id, trim(regexp_replace(translate(lower(equipment_involved), '{PUNCTUATION}', ''), '\\s+', ' ', 'g')) clean, trim(regexp_replace(regexp_replace(lower(equipment_involved), '[^{T.LETTERS}0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) spaced,
    regexp_replace(regexp_replace(lower(strip_accents(division)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') slug, left(accident_summary, 40) short from (select distinct doc_id, equipment_involved, division, accident_summary from data_metallurgie where doc_id is not null)"""
)
def clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    """H1, H2, H15, H18."""
    d = table(spark, sf, "data_metallurgie").where("doc_id is not null").select("doc_id", "equipment_involved", "division", "accident_summary").distinct()
    return d.select("doc_id", T.clean(F.col("equipment_involved")).alias("clean"), T.clean_spaced(F.col("equipment_involved")).alias("spaced"), T.slug(F.col("division")).alias("slug"), T.shortened(F.col("accident_summary"), 40).alias("short"))


@query(f"with {PREDICTIONS} select doc_id, printf('Z_%02d_%s', z_hat, z_dominant_macro) variable, z_hat topic, repeat('█', round_even(least(greatest(p_a0_given_z, 0), 1) * 10, 0)::int) || repeat('░', 10 - round_even(least(greatest(p_a0_given_z, 0), 1) * 10, 0)::int) bar from predictions where z_hat >= 0 and z_dominant_macro is not null and p_a0_given_z is not null and not isnan(p_a0_given_z)")
def node_cards(spark: SparkSession, sf: str) -> DataFrame:
    """H13, H17."""
    p = predictions(spark, sf).where(F.col("z_dominant_macro").isNotNull() & (F.col("z_hat") >= 0) & F.col("p_a0_given_z").isNotNull() & ~F.isnan("p_a0_given_z"))
    v = S.topic_variable(F.col("z_hat"), F.col("z_dominant_macro"))
    return p.select("doc_id", v.alias("variable"), S.topic_of_variable(v).alias("topic"), S.bar(F.col("p_a0_given_z")).alias("bar"))


@query(f"with {VECTORS} select doc_id, v[1]::float dim_1, v[2]::float dim_2, v[64]::float dim_64 from vectors")
def wide_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Wide to array and back."""
    return sinks.wide_vectors(embedded(vectors(spark, sf).drop("corpus")), 64).select("doc_id", "dim_1", "dim_2", "dim_64")


@query("select z_id, run_id, coalesce(nullif(trim(left(top_words, 20)), ''), 'Z' || z_id) label from themes_by_z")
def theme_labels(spark: SparkSession, sf: str) -> DataFrame:
    """H16."""
    t = table(spark, sf, "themes_by_z")
    return t.select("z_id", "run_id", T.label_or(F.trim(F.left("top_words", F.lit(20))), F.lit(""), F.concat(F.lit("Z"), F.col("z_id"))).alias("label"))


@query(
    f"""with {NET}, {CPD}, a as (select p from cp where node = 'M_A0' and s = 1), b as (select sum(cp.p * case when given = '1' then a.p else 1 - a.p end) p from cp, a where node = 'M_A1' and s = 1),
    c as (select sum(cp.p * case when given = '1' then b.p else 1 - b.p end) p from cp, b where node = 'M_B' and s = 1), d as (select sum(cp.p * case when given = '1' then c.p else 1 - c.p end) p from cp, c where node = 'severity_high' and s = 1)
    select 'M_A0' parent, 'M_A1' child, round((select p from cp where node = 'M_A1' and given = '1' and s = 1) / p, 6) lift from b union all select 'M_A1', 'M_B', round((select p from cp where node = 'M_B' and given = '1' and s = 1) / p, 6) from c
    union all select 'M_B', 'severity_high', round((select p from cp where node = 'severity_high' and given = '1' and s = 1) / p, 6) from d"""
)
def arc_lift_model(spark: SparkSession, sf: str) -> DataFrame:
    """G8 from fitted tables: P(child | parent) / P(child) along the chain."""
    m = _chain(spark, sf)
    p = {r.node: r.p1 for r in network.chain_marginals(m, CHAIN).collect()}  # a row a node
    out = None
    for a, b in zip(CHAIN, CHAIN[1:]):
        t = network.conditional_table(m, b, [a]).where((F.col(a) == 1) & (F.col(b) == 1)).select(F.lit(a).alias("parent"), F.lit(b).alias("child"), (F.col("p") / F.lit(p[b])).alias("lift"))
        out = t if out is None else out.unionByName(t)
    return rounded(out)


@query("select z_hat epoch, round(avg(z_confidence), 6) loss from pt_z_target where z_confidence is not null and not isnan(z_confidence) and z_hat is not null group by 1")
def epoch_loss(spark: SparkSession, sf: str) -> DataFrame:
    """A40."""
    t = table(spark, sf, "pt_z_target").where(F.col("z_confidence").isNotNull() & ~F.isnan("z_confidence") & F.col("z_hat").isNotNull())
    return rounded(splits.epoch_loss(t.select(F.col("z_hat").alias("epoch"), F.col("z_confidence").alias("loss"))))


@query(
    f"""with {UNITS}, {VECTORS}, {UNIT_VECTORS}, l as (select doc_id, pred_label c, unnest(u) x, generate_subscripts(u, 1) i from units join unit_vectors using (doc_id)), m as (select c, i, avg(x) m from l group by 1, 2),
    s as (select l.doc_id, l.c own, m.c, -sum((x - m) * (x - m)) s from l join m using (i) group by 1, 2, 3), e as (select doc_id, own, c, 20 * (s - case when own = c then 0.01 else 0 end) l from s),
    z as (select doc_id, ln(sum(exp(l))) - sum(case when c = own then l else 0 end) ce from e group by 1) select round(avg(ce), 5) loss from z"""
)
def softtriple_loss(spark: SparkSession, sf: str) -> DataFrame:
    """M22 with one centre a label, the mean of its unit vectors."""
    v = geometry.normalised(labelled(spark, sf).drop("macro_id"))
    centres = geometry.centroids(v).select("label", F.lit(0).alias("k"), F.col("vec").alias("centre"))
    return rounded(contrastive.soft_triple(readers.as_array(v), centres), 5)
