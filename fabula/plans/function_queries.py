"""Queries on single functions: masks, encodings, prefixes, tokens, labels, spans, rates, keys, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import network, posterior, splits
from ..sources import readers
from .network_queries import FOLDS, _folds
from .registry import query
from .tables import PREDICTIONS, UNITS, predictions, rounded, table, units
from .vector_queries import MU, _yz, _zx

RAW = "raw as (select distinct doc_id, pred_label l, sentence s from data_btp where doc_id is not null)"


@query(f"with {RAW} select doc_id, l, l is not null and lower(trim(l)) not in ('', 'nan', 'none') valid, 'Classer.' || chr(10) || chr(10) || trim(s) prefixed from raw")
def label_masks(spark: SparkSession, sf: str) -> DataFrame:
    """P9, P23."""
    d = table(spark, sf, "data_btp").where("doc_id is not null").select("doc_id", F.col("pred_label").alias("l"), F.col("sentence").alias("s")).distinct()
    return d.select("doc_id", "l", S.valid_label(F.col("l")).alias("valid"), S.prefixed(F.col("s"), " Classer. ").alias("prefixed"))


@query(f"with {UNITS} select doc_id, (macro_id = 0)::int a0, (macro_id = 1)::int a1, (macro_id = 2)::int b, (macro_id = 3)::int c from units")
def one_hot_labels(spark: SparkSession, sf: str) -> DataFrame:
    """P10."""
    h = S.one_hot(F.col("macro_id"), 4)
    return units(spark, sf).select("doc_id", *[F.get(h, F.lit(i)).cast("int").alias(n) for i, n in enumerate(("a0", "a1", "b", "c"))])


@query("select doc_id, list_distinct(regexp_extract_all(lower(text), '[" + T.LETTERS + "]{2,}')).len() n_words, len(regexp_extract_all(lower(text), '[" + T.LETTERS + "]{2,}')) n_runs from documents where text is not null")
def letter_runs(spark: SparkSession, sf: str) -> DataFrame:
    """H4."""
    r = T.runs(F.col("text"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(F.array_distinct(r)).cast("long").alias("n_words"), F.size(r).cast("long").alias("n_runs"))


WORDS = "w as (select run_id, z_id, list_filter(string_split(coalesce(top_words, ''), ' '), lambda x: x <> '') w from themes_by_z where run_id is not null and z_id is not null)"


@query(f"with {WORDS}, p as (select run_id, z_id, case when len(w) < 4 then list_concat(w, (['topic', 'without', 'more', 'words'])[1:4 - len(w)]) else w end f from w) select run_id, z_id, array_to_string(f[1:6], ' ') || case when len(f) > 6 then '…' else '' end label from p")
def clamped_labels(spark: SparkSession, sf: str) -> DataFrame:
    """H10."""
    t = table(spark, sf, "themes_by_z").where("run_id is not null and z_id is not null")
    w = F.filter(F.split(F.coalesce("top_words", F.lit("")), " "), lambda x: x != "")
    return t.select("run_id", "z_id", T.clamped_label(w, ["topic", "without", "more", "words"], 4, 6).alias("label"))


@query("select doc_id, case when doc_id % 3 < 2 then doc_id end a, case when doc_id % 3 = 0 then coalesce(source, 'x') end b from documents")
def json_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with text around an object, without an object, and broken."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("x")).alias("s"))
    whole = F.concat(F.lit("Voici :\n```"), F.to_json(F.struct(F.col("doc_id").alias("a"), F.col("s").alias("b"))), F.lit("```"))
    reply = F.when(F.col("doc_id") % 3 == 0, whole).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x {\"a\": "), F.col("doc_id").cast("string"), F.lit("} y"))).otherwise("none")
    got = T.embedded_json(reply, "a long, b string")
    return d.select("doc_id", got["a"].alias("a"), got["b"].alias("b"))


@query(
    """with t as (select doc_id, replace(text, chr(13), ' ') t from documents where text is not null and doc_id is not null),
    p as (select doc_id, unnest(string_split(t, chr(10))) s, generate_subscripts(string_split(t, chr(10)), 1) i from t),
    q as (select doc_id, i, s, coalesce(sum(len(s) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::int a from p)
    select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int span, a \"start\", (a + len(s))::int \"end\" from q where s <> ''"""
)
def line_spans(spark: SparkSession, sf: str) -> DataFrame:
    """H19 on whole texts, line by line."""
    t = table(spark, sf, "documents").where("text is not null and doc_id is not null").select("doc_id", F.regexp_replace("text", "\r", " ").alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda s: s != "")
    return t.select("doc_id", F.posexplode(T.spans(F.col("t"), lines)).alias("span", "x")).select("doc_id", "span", "x.start", "x.end")


@query(f"with {FOLDS}, e as (select distinct z_hat epoch from pt_z_target where z_hat >= 0) select epoch, round(0.01 * 0.5 * (1 + cos(pi() * (epoch % 5) / 5)), 9) rate from e")
def learning_rates(spark: SparkSession, sf: str) -> DataFrame:
    """H23."""
    e = table(spark, sf, "pt_z_target").where("z_hat >= 0").select(F.col("z_hat").alias("epoch")).distinct()
    return rounded(e.select("epoch", S.cosine_rate(0.01, F.col("epoch"), 5).alias("rate")), 9)


@query("select distinct source, case source when 'portail' then 'Portail' when 'papier' then 'Papier' else source end shown from documents")
def display_names(spark: SparkSession, sf: str) -> DataFrame:
    """H24, U5."""
    return table(spark, sf, "documents").select("source").distinct().select("source", S.display_name(F.col("source"), {"portail": "Portail", "papier": "Papier"}).alias("shown"))


@query("select run_id, z_id, row_number() over (order by run_id, z_id) doc_id from themes_by_z where run_id is not null and z_id is not null")
def keyed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """P5."""
    t = table(spark, sf, "themes_by_z").where("run_id is not null and z_id is not null").select("run_id", "z_id")
    return readers.with_key(t, ["run_id", "z_id"])


@query("select 'company_code' name union all select 'source'")
def varying_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A constant column is dropped, one of a value and nulls isn't."""
    d = table(spark, sf, "documents").select("source", F.lit(1).alias("same"), F.when(F.col("company_code") == F.lit(None), "x").otherwise(F.when(F.col("doc_id") % 2 == 0, "x")).alias("company_code"))
    return spark.createDataFrame([(c,) for c in network.varying(d, ["source", "same", "company_code"])], "name string")


@query(f"with {FOLDS} select fold_id combo, round(confidence, 6) confidence from f order by confidence desc, fold_id limit 1")
def best_combo(spark: SparkSession, sf: str) -> DataFrame:
    """An undefined score never wins."""
    f = _folds(spark, sf).select(F.col("fold_id").alias("combo"), "confidence")
    return rounded(splits.best_combo(f.unionByName(f.select(F.concat(F.lit("a"), "combo").alias("combo"), F.lit(float("nan")).alias("confidence"))), "confidence"))


@query("select * from (values ('batch=16_lr=1e-03'), ('batch=16_lr=5e-04'), ('batch=32_lr=1e-03'), ('batch=32_lr=5e-04')) t(combo)")
def grid_names(spark: SparkSession, sf: str) -> DataFrame:
    """H20, M25."""
    return spark.createDataFrame([(g["combo"],) for g in splits.grid({"train.lr": [1e-3, 5e-4], "batch": [16, 32]})], "combo string")


@query(f"with {MU} select doc_id, round(max(greatest(p, 1e-8) * greatest(q, 1e-8)), 5) best_score from zx join yz using (z) join tr using (doc_id) where y = pred_label group by 1")
def estep_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M3: the score of hard labels."""
    t = _yz(spark, sf).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "q"))), lambda s: s["q"]).alias("qs"))
    rows = _zx(spark, sf).where(F.col("pred_label").isin(*S.MACROS)).crossJoin(F.broadcast(t))  # a single row
    s = posterior.em_score(F.col("p"), F.transform(S.one_hot(S.macro_code(F.col("pred_label")), 4), lambda x: x.cast("double")), F.col("qs"))
    return rounded(rows.select("doc_id", F.array_max(s).alias("best_score")), 5)


@query(f"with {PREDICTIONS} select doc_id, (case greatest(p_a0_given_z, p_a1_given_z, p_b_given_z, p_c_given_z) when p_a0_given_z then 0 when p_a1_given_z then 1 when p_b_given_z then 2 else 3 end)::int q_init from predictions where " + " and ".join(f"{c} is not null and not isnan({c})" for c in ("p_a0_given_z", "p_a1_given_z", "p_b_given_z", "p_c_given_z")))
def initial_topics(spark: SparkSession, sf: str) -> DataFrame:
    """M7, from scores."""
    four = ["p_a0_given_z", "p_a1_given_z", "p_b_given_z", "p_c_given_z"]
    p = predictions(spark, sf).where(" and ".join(f"{c} is not null and not isnan({c})" for c in four))
    return posterior.initial_topics(p.select("doc_id", F.array(*four).alias("s")), 4, "argmax").select("doc_id", F.col("q_init").cast("int").alias("q_init"))


@query("select doc_id, n_chars from documents where doc_id is not null order by n_chars desc nulls last, doc_id limit 25")
def head_capped(spark: SparkSession, sf: str) -> DataFrame:
    """A cap after a total order, as a report of the longest documents."""
    return splits.capped(table(spark, sf, "documents").where("doc_id is not null").select("doc_id", "n_chars"), 25, F.desc_nulls_last("n_chars"), F.asc("doc_id"))
