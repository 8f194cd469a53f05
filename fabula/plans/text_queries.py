"""Queries on units, words and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import agreement, quality, topics
from ..sources import readers
from .registry import query
from .tables import PREDICTIONS, UNITS, VECTORS, labelled, predictions, rounded, table, units, vectors


@query(f"with {UNITS} select doc_id, accident_id, fact_id, sentence, pred_label, macro_id::int macro_id, pred_subtype, company_code from units")
def units_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select("doc_id", "accident_id", "fact_id", "sentence", "pred_label", "macro_id", "pred_subtype", "company_code")


@query(f"with {UNITS}, {VECTORS} select doc_id, pred_label, round(v[1], 6) first, round(v[64], 6) last from units join vectors using (doc_id)")
def emb_join(spark: SparkSession, sf: str) -> DataFrame:
    v = labelled(spark, sf)
    return rounded(v.select("doc_id", F.col("label").alias("pred_label"), F.col("dim_1").cast("double").alias("first"), F.col("dim_64").cast("double").alias("last")))


@query(f"with {UNITS}, {VECTORS} select doc_id, pred_label from units where doc_id not in (select doc_id from vectors)")
def emb_join_loss(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).join(vectors(spark, sf), "doc_id", "left_anti").select("doc_id", "pred_label")


@query(f"with {UNITS} select pred_label, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from units group by 1")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    c = units(spark, sf).groupBy("pred_label").agg(F.count("*").alias("n"))
    return rounded(c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))  # a row a label


@query("""select doc_id, case when trim(sentence) <> '' and lower(trim(sentence)) <> 'nan' then true else false end ok, case when lower(trim(pred_ok)) in ('true','1','yes','t') then true else false end accepted,
 coalesce(list_position(['A0','A1','B','C'], pred_label) - 1, -1)::int code, count(*) n from data_metallurgie group by all""")
def target_flags(spark: SparkSession, sf: str) -> DataFrame:
    """S3, P1, P4, P8 on the target corpus."""
    df = readers.target_units(table(spark, sf, "data_metallurgie"))
    return df.groupBy("doc_id", S.valid_text(F.col("sentence")).alias("ok"), S.tolerant_bool(F.col("pred_ok")).alias("accepted"), F.col("macro_id").alias("code")).agg(F.count("*").alias("n"))


@query(f"with {PREDICTIONS}, m as (select unnest(['A0','A1','B','C']) source) select source, count(*) filter (pt_macro_name = 'A0') \"A0\", count(*) filter (pt_macro_name = 'A1') \"A1\", count(*) filter (pt_macro_name = 'B') \"B\", count(*) filter (pt_macro_name = 'C') \"C\" from m left join predictions on p0_macro_name = source group by source")
def macro_transition(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.transition(predictions(spark, sf), "p0_macro_name", "pt_macro_name")


@query(f"with {PREDICTIONS} select p0_macro_name, pt_macro_name, count(*) n from predictions where p0_macro_name is not null and pt_macro_name is not null group by 1, 2")
def macro_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.crosstab(predictions(spark, sf), "p0_macro_name", "pt_macro_name")


@query(f"with {PREDICTIONS} select count(*) n, round(avg((p0_macro_name is distinct from pt_macro_name)::int), 6) change_rate from predictions")
def change_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.change_rate(predictions(spark, sf), "p0_macro_name", "pt_macro_name"))


@query(f"with {PREDICTIONS} select z_hat a, pred_label b, count(*) n from predictions where z_hat is not null and pred_label is not null group by 1, 2")
def contingency(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.contingency(predictions(spark, sf), "z_hat", "pred_label")


NMI = f"""with {PREDICTIONS}, c as (select pred_label a, z_hat b, count(*) n from predictions where z_hat is not null and pred_label is not null group by 1, 2), t as (select sum(n)::double n from c),
 ca as (select a, sum(n)::double n from c group by 1), cb as (select b, sum(n)::double n from c group by 1),
 e as (select (select n from t) n, (select ln((select n from t)) - sum(n * ln(n)) / (select n from t) from ca) ha, (select ln((select n from t)) - sum(n * ln(n)) / (select n from t) from cb) hb,
  (select ln((select n from t)) - sum(n * ln(n)) / (select n from t) from c) hj, (select sum(n * (n - 1) / 2) from c) pj, (select sum(n * (n - 1) / 2) from ca) pa, (select sum(n * (n - 1) / 2) from cb) pb)"""


@query(f"{NMI} select n::bigint n, round((ha + hb - hj) / ((ha + hb) / 2), 6) nmi, round((pj - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) ari, round(1 - (hj - hb) / ha, 6) homogeneity from e")
def nmi_ari(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.nmi_ari(predictions(spark, sf), "pred_label", "z_hat"))


@query(f"{NMI} select round(avg(p), 6) purity from (select max(n) / sum(n) p from c group by b)")
def homogeneity_purity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.purity(predictions(spark, sf), "pred_label", "z_hat"))


@query(
    f"""with {PREDICTIONS}, p as (select pred_label a, pt_macro_name b from predictions where pred_label in ('A0','A1','B','C') and pt_macro_name in ('A0','A1','B','C')),
    l as (select unnest(['A0','A1','B','C']) l), s as (select l, (select count(*) from p where a = l) t, (select count(*) from p where b = l) g, (select count(*) from p where a = l and b = l) h from l)
    select sum(t)::bigint n, round(sum(h) / sum(t), 6) accuracy, round(avg(2 * h / (t + g)) filter (t + g > 0), 6) macro_f1, round(avg(h / t) filter (t > 0), 6) balanced_accuracy from s"""
)
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.classification(predictions(spark, sf), "pred_label", "pt_macro_name"))


@query(f"with {PREDICTIONS} select least(floor(z_confidence * 40)::int + 1, 40) bin, count(*) n from predictions where z_confidence between 0 and 1 group by 1")
def confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.histogram(predictions(spark, sf), F.col("z_confidence"))


@query()
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.silhouette(readers.as_array(labelled(spark, sf)), "label"))


# words --------------------------------------------------------------------------------------------------------------------

WORDS = f"""tok as (select pred_label t, doc_id, w from (select pred_label, doc_id, unnest(regexp_split_to_array(lower(sentence), '[^\\p{{L}}\\p{{N}}_\\p{{M}}]+')) w from units where sentence is not null) where regexp_full_match(w, '[{T.LETTERS}]{{2,}}')),
 pd as (select t, doc_id, w, count(*) n from tok group by 1, 2, 3), tm as (select t, w, sum(n)::bigint tf, count(*) df from pd group by 1, 2),
 sz as (select pred_label t, count(*) n from units where sentence is not null group by 1), kept as (select tm.* from tm join sz using (t) where df <= n * 0.95)"""


@query(f"with {UNITS}, {WORDS} select t pred_label, w term, tf, df from kept")
def tokens_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the tokens of each label's sentences, very common ones left out."""
    return topics.term_counts(units(spark, sf), "pred_label")


@query(f"with {UNITS}, {WORDS}, s as (select t, w, tf / (sum(tf) over (partition by t) + 1e-12) * ln(1 + 1 / (1 + 1e-12)) s from kept), r as (select *, row_number() over (partition by t order by round(s, 9) desc, w) k from s) select t pred_label, w term, round(s, 6) score, k::int place from r where k <= 10")
def ctfidf_top_words(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(topics.top_terms(topics.class_tfidf(topics.term_counts(units(spark, sf), "pred_label"), "pred_label"), "pred_label"))


@query(
    f"""with {UNITS}, {WORDS}, d as (select w, count(*) d from kept group by 1), s as (select t, w, tf / (sum(tf) over (partition by t) + 1e-12) * ln(1 + (select count(distinct t) from kept) / (d + 1e-12)) s from kept join d using (w)),
    r as (select *, row_number() over (partition by t order by round(s, 9) desc, w) k from s) select t pred_label, w term, round(s, 6) score, k::int place from r where k <= 10"""
)
def ctfidf_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(topics.top_terms(topics.class_tfidf(topics.term_counts(units(spark, sf), "pred_label"), "pred_label", separate=False), "pred_label"))


TFIDF = f"""tk as (select pred_label t, doc_id, w from (select pred_label, doc_id, unnest(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(sentence), '[^{T.LETTERS}0-9]+', ' ', 'g'), '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\p{{M}}]+')) w from units where sentence is not null) where regexp_full_match(w, '[{T.LETTERS}]{{2,}}')),
 pd as (select t, doc_id, w, count(*) tf from tk group by 1, 2, 3), vo as (select t, w, count(*) df from pd group by 1, 2 qualify row_number() over (partition by t order by sum(tf) desc, w) <= 5000),
 sz as (select pred_label t, count(*) n from units where sentence is not null group by 1), wt as (select pd.t, doc_id, pd.w, tf * (ln((1 + n) / (1 + df)) + 1) x from pd join vo using (t, w) join sz using (t)),
 ln2 as (select t, doc_id, sqrt(sum(x * x)) l from wt group by 1, 2), sc as (select wt.t, wt.w, sum(x / l) s from wt join ln2 using (t, doc_id) group by 1, 2)"""


@query(f"with {UNITS}, {TFIDF}, r as (select *, row_number() over (partition by t order by round(s, 9) desc, w) k from sc) select t pred_label, w term, round(s, 5) score, k::int place from r where k <= 10")
def tfidf_top_words(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(topics.top_terms(topics.tfidf(units(spark, sf), "pred_label"), "pred_label"), 5)


@query(
    f"""with {UNITS}, {VECTORS}, lv as (select doc_id, pred_label c, v from units join vectors using (doc_id)), l as (select doc_id, c, unnest(v) x, generate_subscripts(v, 1) i from lv), m as (select c, i, avg(x) m from l group by 1, 2),
    f as (select l.c, doc_id, round(sqrt(sum((x - m) * (x - m))), 6) d from l join m using (c, i) group by 1, 2) select c label, doc_id, d distance, row_number() over (partition by c order by d, doc_id)::int place from f qualify place <= 5"""
)
def top_sentences_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return topics.nearest_sentences(labelled(spark, sf).drop("macro_id"), "label")


@query(f"with {PREDICTIONS} select z_hat, doc_id, z_confidence, row_number() over (partition by z_hat order by z_confidence desc, doc_id)::int place from predictions where z_hat is not null and z_confidence is not null and not isnan(z_confidence) qualify place <= 5")
def top_sentences_prob(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).where(F.col("z_confidence").isNotNull() & ~F.isnan("z_confidence")).select("z_hat", "doc_id", "z_confidence")
    return topics.top_rows(p, "z_hat", [F.desc("z_confidence"), F.asc("doc_id")], 5)


TARGET = """target as (select doc_id, any_value(sentence) sentence from data_metallurgie where doc_id is not null and sentence is not null group by 1),
 tu as (select p.doc_id, p.z_hat, p.pred_label, p.pred_severity, p.z_confidence, sentence from predictions p left join target using (doc_id) where z_hat is not null)"""


def _target(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "data_metallurgie").where("doc_id is not null and sentence is not null").groupBy("doc_id").agg(F.min("sentence").alias("sentence"))
    return predictions(spark, sf).where("z_hat is not null").select("doc_id", "z_hat", "pred_label", "pred_severity", "z_confidence").join(s, "doc_id", "left")


def _themes(spark: SparkSession, sf: str) -> DataFrame:
    t = _target(spark, sf)
    scores = topics.class_tfidf(topics.term_counts(t, "z_hat"), "z_hat")
    best = topics.top_rows(t.where("sentence is not null and z_confidence is not null and not isnan(z_confidence)").select("z_hat", "doc_id", "z_confidence", "sentence"), "z_hat", [F.desc("z_confidence"), F.asc("doc_id")], 3)
    return topics.themes(t, "z_hat", scores, best)


THEMES = f"""{PREDICTIONS}, {TARGET}, tok as (select z_hat t, doc_id, w from (select z_hat, doc_id, unnest(regexp_split_to_array(lower(sentence), '[^\\p{{L}}\\p{{N}}_\\p{{M}}]+')) w from tu where sentence is not null) where regexp_full_match(w, '[{T.LETTERS}]{{2,}}')),
 pd as (select t, doc_id, w, count(*) n from tok group by 1, 2, 3), tm as (select t, w, sum(n)::bigint tf, count(*) df from pd group by 1, 2), sz as (select z_hat t, count(*) n from tu where sentence is not null group by 1),
 kept as (select tm.* from tm join sz using (t) where df <= n * 0.95), sk as (select t, w, round(tf / (sum(tf) over (partition by t) + 1e-12) * ln(1 + 1 / (1 + 1e-12)), 9) s from kept), rk as (select t, w, row_number() over (partition by t order by s desc, w) k from sk),
 wd as (select t, list(w order by k) words from rk where k <= 10 group by 1),
 st as (select z_hat t, sentence s, row_number() over (partition by z_hat order by z_confidence desc, doc_id) k from tu where sentence is not null and z_confidence is not null and not isnan(z_confidence)),
 ss as (select t, string_agg(s, ' || ' order by k) s from st where k <= 3 group by 1), dm as (select z_hat t, pred_label, count(*) n from tu group by 1, 2),
 d1 as (select t, pred_label from dm qualify row_number() over (partition by t order by n desc, pred_label nulls last) = 1), un as (select z_hat t, count(*) n from tu group by 1),
 themes as (select un.t z_hat, d1.pred_label dominant_macro, n n_units, array_to_string(words, ' ') top_words, words, ss.s top_sentences from un left join d1 using (t) left join wd using (t) left join ss using (t))"""


@query(f"with {THEMES} select z_hat, dominant_macro, n_units, top_words, top_sentences from themes")
def themes_by_z(spark: SparkSession, sf: str) -> DataFrame:
    return _themes(spark, sf)


@query(f"with {THEMES}, r as (select *, row_number() over (partition by dominant_macro order by n_units desc, z_hat) r from themes where dominant_macro is not null) select dominant_macro, count(*) n_topics, sum(n_units)::bigint n_units, string_agg(coalesce(top_words, ''), ' | ' order by r) filter (r <= 5) words from r group by 1")
def themes_by_macro(spark: SparkSession, sf: str) -> DataFrame:
    return topics.themes_by_macro(_themes(spark, sf), "z_hat")


@query(f"with {THEMES} select z_hat, case when len(coalesce(words, [])) > 0 then left(array_to_string(words[1:3], ', '), 60) else '-' end label from themes")
def fallback_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _themes(spark, sf).select("z_hat", T.fallback_label(F.filter(F.split(F.coalesce("top_words", F.lit("")), " "), lambda w: w != "")).alias("label"))


@query(f"with {PREDICTIONS}, {TARGET}, c as (select z_hat, pred_severity v, count(*) n from tu where pred_severity is not null group by 1, 2), r as (select *, row_number() over (partition by z_hat order by n desc, v) r from c) select z_hat, string_agg(v || ':' || n, ' | ' order by r) \"values\" from r where r <= 5 group by 1")
def top_severities(spark: SparkSession, sf: str) -> DataFrame:
    return topics.top_values(_target(spark, sf), "z_hat", "pred_severity")


def _topic_table(spark: SparkSession, sf: str) -> DataFrame:
    return _themes(spark, sf).select(F.col("z_hat").cast("string").alias("id"), F.filter(F.split(F.coalesce("top_words", F.lit("")), " "), lambda w: w != "").alias("words"), F.col("n_units").alias("n_docs"), F.col("dominant_macro").alias("macro"))


REAL = "tt as (select z_hat::varchar id, coalesce(words, []) words, n_units n_docs, dominant_macro macro from themes where z_hat <> -1)"


@query(f"with {THEMES}, tt as (select z_hat::varchar id, coalesce(words, []) words from themes) select round(d / (n * 10), 6) topic_diversity, round(1 - d / (n * 10), 6) redundancy from (select (select count(distinct w) from (select unnest(words) w from tt)) d, (select count(*) from tt) n)")
def topic_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.diversity(_topic_table(spark, sf), 10))


JAC = "jc as (select x.id a, y.id b, coalesce(len(list_intersect(x.words, y.words)) / nullif(len(list_distinct(list_concat(x.words, y.words))), 0), 0) jaccard from tt x join tt y on x.id < y.id)"


@query(f"with {THEMES}, tt as (select z_hat::varchar id, coalesce(words, []) words from themes), {JAC} select a, b, round(jaccard, 6) jaccard from jc")
def topic_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.jaccard(_topic_table(spark, sf)))


@query(f"with {THEMES}, {REAL}, {JAC} select (select count(*) from tt) n_topics, count(*) n_valid_topics, round((select sum(n_docs) from tt) / (select count(*) from predictions), 6) coverage, round((select count(distinct w) from (select unnest(words) w from tt)) / (count(*) * 10), 6) topic_diversity, round(1 - (select count(distinct w) from (select unnest(words) w from tt)) / (count(*) * 10), 6) redundancy, round((select avg(jaccard) from jc), 6) mean_pairwise_jaccard, round(avg(n_docs), 6) mean_topic_size, round(median(n_docs), 6) median_topic_size from tt")
def topic_quality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.quality_row(_topic_table(spark, sf), predictions(spark, sf).count()))


@query(f"with {THEMES}, {REAL} select coalesce(sum(n_docs), 0)::bigint in_topics, (select count(*) from predictions) n_docs, round(sum(n_docs) / (select count(*) from predictions), 6) coverage from tt")
def topic_coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = predictions(spark, sf).agg(F.count("*").alias("n_docs"))
    s = _topic_table(spark, sf).where(~S.outlier_topic(F.col("id"))).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("in_topics"))
    return rounded(s.crossJoin(F.broadcast(n)).select("in_topics", "n_docs", (F.col("in_topics") / F.col("n_docs")).alias("coverage")))  # one row each


@query(f"with {THEMES}, {REAL}, dm2 as (select pred_label macro, count(*) n from predictions where pred_label is not null group by 1) select macro, count(*) n_topics, sum(n_docs)::bigint n_docs_in_topics, round(sum(n_docs) / any_value(n), 6) coverage, round((select count(distinct w) from (select macro m, unnest(words) w from tt) where m = tt.macro) / (count(*) * 10), 6) topic_diversity from tt left join dm2 using (macro) group by macro")
def macro_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = predictions(spark, sf).where("pred_label is not null").groupBy(F.col("pred_label").alias("macro")).agg(F.count("*").alias("n"))
    return rounded(quality.macro_quality(_topic_table(spark, sf).where("macro is not null"), docs))


@query(
    f"""with {THEMES}, tt as (select z_hat::varchar id, coalesce(words, []) words from themes), wl as (select id, unnest(words) w, generate_subscripts(words, 1) k from tt),
    tx as (select doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(translate(lower(sentence), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\p{{M}}]+'), lambda x: regexp_full_match(x, '[{T.LETTERS}]{{2,}}')) t from target),
    wi as (select doc_id, pos, t[pos:pos + 9] ws from (select doc_id, t, unnest(generate_series(1, greatest(len(t) - 9, 1))) pos from tx where len(t) > 0)), n as (select count(*)::double n from wi),
    oc as (select distinct doc_id, pos, w from (select doc_id, pos, unnest(ws) w from wi) where w in (select w from wl)), c1 as (select w, count(*) c from oc group by 1),
    pr as (select a.id, a.w wa, b.w wb from wl a join wl b on a.id = b.id and a.k < b.k), pp as (select distinct wa, wb from pr),
    c2 as (select wa, wb, count(*) c from pp join oc x on x.w = wa join oc y on y.w = wb and x.doc_id = y.doc_id and x.pos = y.pos group by 1, 2)
    select id, round(avg(case when c2.c is null then -1 when c2.c = n then 1 else ln((c2.c / n) / ((x.c / n) * (y.c / n))) / -ln(c2.c / n) end), 5) npmi from pr left join c2 using (wa, wb) left join c1 x on x.w = wa left join c1 y on y.w = wb, n group by id"""
)
def npmi(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return rounded(quality.npmi(docs, _topic_table(spark, sf).where("size(words) > 0")), 5)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "data_metallurgie").where("doc_id is not null and sentence is not null").groupBy("doc_id").agg(F.min("sentence").alias("sentence"))


@query()
def cv_coherence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.context_coherence(_docs(spark, sf), _topic_table(spark, sf).where("size(words) > 0")), 5)


STOP_LIST = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(
    f"""with w as (select run_id, z_id, list_transform(regexp_split_to_array(coalesce(top_words, ''), '[\\s,;]+'), lambda w: lower(trim(w))) w, regexp_split_to_array(coalesce(top_sentences, ''), '\\s*\\|\\|\\s*') s from themes_by_z)
    select run_id, z_id, list_sort(list_distinct(list_filter(w, lambda w: len(w) >= 3 and not regexp_full_match(w, '[0-9]+') and not list_contains({STOP_LIST}, w)))) words, len(list_filter(s, lambda s: trim(s) <> ''))::int n_sentences from w"""
)
def theme_export(spark: SparkSession, sf: str) -> DataFrame:
    """H8, H9 on the older theme export: distinct valid words in alphabetical order, number of sentences."""
    t = table(spark, sf, "themes_by_z")
    return t.select("run_id", "z_id", F.array_sort(T.packed_words(F.col("top_words"))).alias("words"), F.size(T.packed_sentences(F.col("top_sentences"))).alias("n_sentences"))
