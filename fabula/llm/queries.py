"""The pN_ queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    docs = _read(spark, sf, "data_btp").select("doc_id", F.col("sentence").alias("text"))
    return near_duplicates(docs, 0.7).where("doc_id > group_doc_id").select("group_doc_id", "doc_id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from .cross_split import cross_split

    btp = _read(spark, sf, "data_btp").select("doc_id", F.col("sentence").alias("text"), F.when(F.col("split_name") == "train", 1).when(F.col("split_name").isin("validation", "test"), 2).alias("side"))
    other = _read(spark, sf, "data_metallurgie").select("doc_id", F.col("sentence").alias("text"), F.lit(2).alias("side"))
    return cross_split(btp.union(other), 0.7).select("doc_id_a", "doc_id_b")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from .nearest import most_similar

    near = most_similar(_read(spark, sf, "qwen3_embedding"), 5, 0.94)
    return near.select(F.least("doc_id", "other_id").alias("doc_id_a"), F.greatest("doc_id", "other_id").alias("doc_id_b")).distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from .top_n import top_n

    return top_n(_read(spark, sf, "pt_z_target"), 5).select("run_id", "z_hat", "doc_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from .clusters import clusters

    predictions = _read(spark, sf, "metadata_with_malt_predictions")
    records, topics = clusters(_read(spark, sf, "qwen3_embedding"), predictions.select("doc_id", "z_hat"))
    wanted = predictions.select("doc_id").where("doc_id is not null").distinct()
    return records.join(wanted.hint("merge"), "doc_id").join(topics.where("z_cluster is not null"), "cluster").select("doc_id", "z_cluster")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from .linked_splits import split_leaks

    return split_leaks(_read(spark, sf, "data_btp"), _read(spark, sf, "accident_links"))


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    from .linked_splits import linked_splits

    return linked_splits(_read(spark, sf, "data_btp"), _read(spark, sf, "accident_links"), _read(spark, sf, "split_targets"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from .balanced_sample import cube_sample

    _, report = cube_sample(_read(spark, sf, "data_btp"), _read(spark, sf, "label_targets"))
    return report.where("short > 0").select("plan_id", "pred_label")


def p6_sample(spark: SparkSession, sf: str) -> DataFrame:
    from .balanced_sample import cube_sample

    return cube_sample(_read(spark, sf, "data_btp"), _read(spark, sf, "label_targets"))[0]


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    from .tokens import encode

    return encode(_read(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))[1].where("short").select("mix_id", "source")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))[0]


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    from .residue import residue

    return residue(_read(spark, sf, "documents")).where("doc_id is not null").select("doc_id").distinct()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per corpus, split and source: evaluation records, and how many of them overlap training records."""
    found = p1_found(spark, sf)
    hit = found.select(F.col("doc_id_a").alias("doc_id")).union(found.select(F.col("doc_id_b").alias("doc_id"))).distinct().withColumn("hit", F.lit(1))
    btp = _read(spark, sf, "data_btp").where(F.col("split_name").isin("validation", "test")).select("doc_id", F.lit("btp").alias("corpus"), "split_name", "source")
    other = _read(spark, sf, "data_metallurgie").select("doc_id", F.lit("metallurgie").alias("corpus"), F.lit("test").alias("split_name"), "source")
    rows = btp.union(other).where("doc_id is not null").groupBy("doc_id", "corpus", "split_name").agg(F.min("source").alias("source"))
    return rows.join(hit, "doc_id", "left").groupBy("corpus", "split_name", "source").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))


def p4_top_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Fresh lists for the older theme export: the sentences of the best records of every topic, joined by ||."""
    from .top_n import top_n

    top = top_n(_read(spark, sf, "pt_z_target"), 5)
    text = _read(spark, sf, "data_metallurgie").where("doc_id is not null and sentence is not null").groupBy("doc_id").agg(F.min("sentence").alias("sentence"))
    rows = top.join(text, "doc_id").groupBy("run_id", F.col("z_hat").alias("z_id")).agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("s"))  # five a group
    return rows.select("run_id", "z_id", F.concat_ws(" || ", F.transform("s", lambda x: x["sentence"])).alias("top_sentences"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each group with size, prevailing topic and its five most typical members."""
    from .clusters import clusters, typical

    records, topics = clusters(_read(spark, sf, "qwen3_embedding"), _read(spark, sf, "metadata_with_malt_predictions").select("doc_id", "z_hat"))
    best = typical(records).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda s: s["doc_id"]).alias("typical"))  # five a group
    return topics.join(best, "cluster")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    from .balanced_sample import cube_sample

    return cube_sample(_read(spark, sf, "data_btp"), _read(spark, sf, "label_targets"))[1]


def p10_clean(spark: SparkSession, sf: str) -> DataFrame:
    from .residue import clean

    return clean(_read(spark, sf, "documents")).select("doc_id", "source")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_report, p2_found, p3_found, p3_splits, p4_found, p4_top_sentences, p5_found, p5_groups, p6_found, p6_sample, p6_report, p7_found, p8_ids, p9_found, p9_mix, p9_report, p10_found, p10_clean)
}
SQL: dict[str, str] = {
    "p4_found": """
        with v as (select run_id, doc_id, z_hat, case when isnan(z_confidence) then null else z_confidence end s, scored_at
                   from pt_z_target where run_id is not null and doc_id is not null),
        l as (select *, row_number() over (partition by run_id, doc_id order by scored_at desc nulls last, s desc nulls last, z_hat desc nulls last) r from v),
        t as (select *, row_number() over (partition by run_id, z_hat order by s desc, doc_id) k from l where r = 1 and s is not null and z_hat is not null)
        select run_id, z_hat, doc_id from t where k <= 5""",
    "p3_found": """
        with recursive k as (select 'ACC-' || regexp_replace(accident_id, '[^0-9]', '', 'g') a, split_name from data_btp where length(regexp_replace(accident_id, '[^0-9]', '', 'g')) = 9),
        e as (select 'ACC-' || regexp_replace(accident_id_a, '[^0-9]', '', 'g') a, 'ACC-' || regexp_replace(accident_id_b, '[^0-9]', '', 'g') b from accident_links),
        g as (select a, b from e union select b, a from e),
        r as (select distinct a, a b from k union select r.a, g.b from r join g on r.b = g.a)
        select r.a accident_id from r join k on r.b = k.a group by r.a having count(distinct k.split_name) > 1""",
    "p6_found": """
        with d as (select doc_id, min(upper(trim(pred_label))) l from data_btp
                   where lower(trim(pred_ok)) in ('true', '1', 'yes', 't') and doc_id is not null and pred_label is not null group by doc_id),
        c as (select l, count(*) n from d group by l)
        select plan_id, pred_label from label_targets left join c on l = upper(pred_label)
        where coalesce(n, 0) < greatest(min_rows, cast(round(target_share * sample_rows) as bigint))""",
}
SQL["p4_top_sentences"] = (
    SQL["p4_found"].rsplit("select run_id, z_hat, doc_id from t where k <= 5", 1)[0]
    + """select run_id, z_hat z_id, string_agg(sentence, ' || ' order by k) top_sentences from t
        join (select doc_id, min(sentence) sentence from data_metallurgie where doc_id is not null and sentence is not null group by 1) using (doc_id) where k <= 5 group by 1, 2"""
)
SQL["p6_report"] = (
    SQL["p6_found"].rsplit("select plan_id, pred_label from label_targets", 1)[0]
    + """, w as (select plan_id, pred_label, greatest(min_rows, cast(round(target_share * sample_rows) as bigint)) wanted, coalesce(n, 0) eligible from label_targets left join c on l = upper(pred_label))
        select plan_id, pred_label, wanted, eligible, least(wanted, eligible) drawn, greatest(wanted - eligible, 0) short, 0 residual from w"""
)
# word sets of sentences, and pairs by the words they share
WORDS = """unnest(regexp_extract_all(strip_accents(lower(sentence)), '[\\p{L}\\p{N}]+')) w"""
SQL["p1_found"] = f"""
    with r as (select doc_id, sentence, case when split_name = 'train' then 1 else 2 end side from data_btp where split_name in ('train', 'validation', 'test')
               union all select doc_id, sentence, 2 from data_metallurgie),
    s as (select distinct doc_id, side, w from (select doc_id, side, {WORDS} from r where doc_id is not null and sentence is not null)),
    n as (select doc_id, side, count(*) n from s group by 1, 2 having count(*) >= 5),
    c as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.w = b.w and a.side = 1 and b.side = 2 group by 1, 2)
    select distinct least(x, y) doc_id_a, greatest(x, y) doc_id_b from c join n p on p.doc_id = x and p.side = 1 join n q on q.doc_id = y and q.side = 2
    where x <> y and c >= 0.7 * (p.n + q.n - c) - 1e-9"""
SQL["p1_report"] = f"""
    with found as ({SQL["p1_found"]}), hit as (select doc_id_a doc_id from found union select doc_id_b from found),
    e as (select doc_id, 'btp' corpus, split_name, source from data_btp where split_name in ('validation', 'test') union all select doc_id, 'metallurgie', 'test', source from data_metallurgie),
    one as (select doc_id, corpus, split_name, min(source) source from e where doc_id is not null group by 1, 2, 3)
    select corpus, split_name, source, count(*) records, count(hit.doc_id) overlapping from one left join hit using (doc_id) group by 1, 2, 3"""
SQL["p7_found"] = f"""
    with recursive s as (select distinct doc_id, w from (select doc_id, {WORDS} from data_btp where doc_id is not null and sentence is not null)),
    n as (select doc_id, count(*) n from s group by 1 having count(*) >= 5),
    c as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.w = b.w and a.doc_id < b.doc_id group by 1, 2),
    l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where c >= 0.7 * (p.n + q.n - c) - 1e-9),
    e as materialized (select x, y from l union select y, x from l), r as (select x, x y from e union select r.x, e.y from r join e on r.y = e.x)
    select min(y) group_doc_id, x doc_id from r group by x having min(y) < x"""
DIMS = [f"dim_{i}::double" for i in range(1, 65)]
SQL["p2_found"] = f"""
    with v as (select doc_id, [{", ".join(DIMS)}] v, {" + ".join(f"{c} * {c}" for c in DIMS)} l from qwen3_embedding where doc_id is not null),
    u as materialized (select doc_id, min(list_transform(v, lambda x: x / sqrt(l)))::double[64] u from v where l > 0 and l < 'inf'::double group by 1),
    c as (select a.doc_id x, b.doc_id y, array_inner_product(a.u, b.u) c from u a join u b on a.doc_id <> b.doc_id where array_inner_product(a.u, b.u) >= 0.94),
    k as (select x, y from c qualify row_number() over (partition by x order by round(c, 7) desc, y) <= 5)
    select distinct least(x, y) doc_id_a, greatest(x, y) doc_id_b from k"""
