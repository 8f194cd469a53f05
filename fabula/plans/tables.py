"""The logical tables of the core over the driver's tables, and the same as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers

DIMS = [f"dim_{i}" for i in range(1, 65)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return readers.read_table(spark, f"{sf}/{name}.parquet")


def accident(c: str):
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) == 9, F.concat(F.lit("ACC-"), d))


def first_delivery(df: DataFrame) -> DataFrame:
    """The first delivery of each doc_id."""
    return readers.first_by(df.where("doc_id is not null"), "doc_id", F.asc_nulls_last("loaded_at"), F.asc_nulls_last("pred_confidence"))


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted, labelled units of the source corpus, first deliveries."""
    df = first_delivery(readers.labelled_units(table(spark, sf, "data_btp")))
    return df.select("doc_id", accident("accident_id").alias("accident_id"), "fact_id", "sentence", "pred_label", "macro_id", "pred_subtype", "pred_confidence", "company_code", "source", "division")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return readers.usable_vectors(table(spark, sf, "qwen3_embedding"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Wide vectors of units with label."""
    return units(spark, sf).select("doc_id", F.col("pred_label").alias("label"), "macro_id").join(vectors(spark, sf).drop("corpus"), "doc_id")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of the target corpus, one row a doc_id (copies are equal)."""
    df = table(spark, sf, "metadata_with_malt_predictions").where("doc_id is not null")
    df = df.groupBy("doc_id").agg(F.min(F.struct(*[c for c in df.columns if c != "doc_id"])).alias("_v")).select("doc_id", "_v.*")
    return df.withColumn("accident_id", accident("accident_id"))


def embedded(df: DataFrame) -> DataFrame:
    return readers.as_array(df)


ACC = "case when length(regexp_replace(accident_id, '[^0-9]', '', 'g')) = 9 then 'ACC-' || regexp_replace(accident_id, '[^0-9]', '', 'g') end"
LENGTH2 = " + ".join(f"{c}::double * {c}::double" for c in DIMS)
LIST = "[" + ", ".join(f"{c}::double" for c in DIMS) + "]"

UNITS = f"""units as (
  select doc_id, {ACC} accident_id, fact_id, sentence, pred_label, list_position(['A0','A1','B','C'], pred_label) - 1 macro_id, pred_subtype, pred_confidence, company_code, source, division
  from data_btp where pred_label in ('A0','A1','B','C') and lower(trim(pred_ok)) in ('true','1','yes','t') and doc_id is not null
  qualify row_number() over (partition by doc_id order by loaded_at nulls last, pred_confidence nulls last) = 1)"""
VECTORS = f"""vectors as (
  select doc_id, {LIST} v from qwen3_embedding where doc_id is not null and ({LENGTH2}) > 0 and ({LENGTH2}) < 'inf'::double
  qualify row_number() over (partition by doc_id order by dim_1) = 1)"""
UNIT_VECTORS = "unit_vectors as (select doc_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) u from vectors)"
PREDICTIONS = f"""predictions as (
  select doc_id, {ACC} accident_id, pred_label, pred_severity, z_hat, z_confidence, z_dominant_macro, p0_macro_name, pt_macro_name, p_a0_given_z, p_a1_given_z, p_b_given_z, p_c_given_z
  from metadata_with_malt_predictions where doc_id is not null qualify row_number() over (partition by doc_id order by z_hat) = 1)"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as the check compares values; NaN to null."""
    return df.select(*[F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
