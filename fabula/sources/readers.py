"""Sources: units, targets, vectors, metric files, word lists, configurations, models. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_macro, macro_code, tolerant_bool
from . import files

UNIT_SCHEMA = "doc_id long, accident_id string, fact_id int, sentence string, accident_summary string, pred_label string, pred_subtype string, pred_confidence double, pred_ok string, division string, equipment_involved string, company_code string"
#: Text columns in order of preference.
TEXT_COLUMNS = ("sentence", "fact_text", "text", "content")
METRIC_COLUMNS = "method string, corpus string, n_total long, n_valid long, T_balanced double, W_balanced double, B_balanced double, eta2_macro_balanced double, eta2_macro_balanced_perc double, T_weighted double, W_weighted double, B_weighted double, eta2_weighted double, eta2_weighted_perc double, rankme_global double, c1 double, c10 double"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, CSV (with header; a schema is needed) or JSON lines, by the path's ending."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "csv":
        if schema is None:
            raise ValueError("a CSV source needs a schema")
        return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if ending in ("json", "jsonl"):
        return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    return (spark.read.orc if ending == "orc" else spark.read.parquet)(path)


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has the columns; the check reads the schema only."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def available(df: DataFrame, columns: list[str]) -> DataFrame:
    """S5. The columns that df has of those wanted, in their order."""
    return df.select(*[c for c in columns if c in df.columns])


def text_column(df: DataFrame, preferred: str | None = None) -> str:
    """P7. The first text column present."""
    for c in (preferred, *TEXT_COLUMNS):
        if c and c in df.columns:
            return c
    raise ValueError("no text column")


def with_key(df: DataFrame, order: list[str], key: str = "doc_id") -> DataFrame:
    """P5. df with key 1..n in an explicit order, if it has no key. The running number is exact and needs one ordered pass
    per range partition: numbers before a partition come from the partitions' sizes, so no task sees all rows."""
    if key in df.columns:
        return df
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    from ..session import cut

    ranged = cut(ranged)
    sizes = sorted((r._part, r.n, r.low) for r in ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("low")).collect())
    base, at = [], 0
    for p, n, low in sizes:
        base.append((p, at - low + 1))
        at += n
    starts = F.broadcast(spark.createDataFrame(base, "_part int, _base long"))  # one row a partition
    return ranged.join(starts, "_part").withColumn(key, F.col("_row") + F.col("_base")).drop("_part", "_row", "_base")


def labelled_units(df: DataFrame, ok: str = "pred_ok", label: str = "pred_label") -> DataFrame:
    """S1. Accepted units with a macro label and its code, keys untouched. A missing ok column accepts all."""
    required(df, ["doc_id", label])
    keep = is_macro(F.col(label)) & F.col("doc_id").isNotNull()
    if ok in df.columns:
        keep &= tolerant_bool(F.col(ok))
    return df.where(keep).withColumn("macro_id", macro_code(F.col(label)))


def target_units(df: DataFrame, filter_ok: bool = False, ok: str = "pred_ok") -> DataFrame:
    """S3. Unlabelled target units, with the optional filter; the diagnostic label code is -1 where unknown."""
    out = df.where(tolerant_bool(F.col(ok))) if filter_ok and ok in df.columns else df
    return out.withColumn("macro_id", macro_code(F.col("pred_label"), -1)) if "pred_label" in df.columns else out


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """U6. The first row of each key in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def dim_columns(df: DataFrame) -> list[str]:
    """P6. dim_* columns by their number, padded or not, from 0 or 1."""
    return sorted((c for c in df.columns if re.fullmatch(r"dim_\d+", c)), key=lambda c: int(c[4:]))


def squared_length(df: DataFrame) -> Column:
    return sum((F.col(c).cast("double") * F.col(c).cast("double") for c in dim_columns(df)), F.lit(0.0))


def usable_vectors(df: DataFrame) -> DataFrame:
    """S4, S7. Wide vectors that are complete, finite and not zero, one row a doc_id (the least by its dimensions in order)."""
    dims = dim_columns(df)
    length = squared_length(df)
    good = df.where(F.col("doc_id").isNotNull() & (length > 0) & (length < float("inf")) & ~F.isnan(length))
    rows = good.select("doc_id", *(["corpus"] if "corpus" in df.columns else []), *dims)
    # one aggregation by doc_id; the order of a struct's fields is the order of the dimensions
    values = F.struct(*[F.col(c) for c in [*dims, *(["corpus"] if "corpus" in df.columns else [])]])
    return rows.groupBy("doc_id").agg(F.min(values).alias("_v")).select("doc_id", *([F.col("_v.corpus").alias("corpus")] if "corpus" in df.columns else []), *[F.col(f"_v.{c}").alias(c) for c in dims])


def as_array(df: DataFrame, name: str = "embedding") -> DataFrame:
    """Wide to array."""
    dims = dim_columns(df)
    return df.select(*[c for c in df.columns if c not in dims], F.array(*[F.col(c).cast("double") for c in dims]).alias(name))


def join_vectors(units: DataFrame, vectors: DataFrame, strict: bool = True) -> DataFrame:
    """J1, J2. Units with their vectors by doc_id. Strict: both keys unique and no unit lost, else an error."""
    joined = units.join(vectors.drop("corpus"), "doc_id")
    if strict:
        for name, df in (("units", units), ("vectors", vectors)):
            if not df.groupBy("doc_id").count().where("count > 1").isEmpty():
                raise ValueError(f"doc_id is not unique in {name}")
        if not units.join(vectors, "doc_id", "left_anti").isEmpty():
            raise ValueError("units without a vector")
    return joined


def check_files(folder: str, names: list[str]) -> None:
    """S10, U4, J13. Error naming the files of a folder that are missing."""
    if missing := [n for n in names if not files.exists(f"{folder}/{n}")]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")


def first_existing(paths: list[str]) -> str | None:
    """S2, S11. The first path that exists; patterns give their least match."""
    for p in paths:
        if found := files.matching(p):
            return found[0]
    return None


def find_vectors(root: str) -> str | None:
    """S12. The first CSV under a folder, by path, whose header has dim_* columns."""
    for p in files.below(root, ".csv"):
        head = SparkSession.getActiveSession().read.text(p).limit(1).collect()
        if head and any(re.fullmatch(r"dim_\d+", c.strip()) for c in head[0].value.split(",")):
            return p
    return None


def metric_rows(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """S13, P18, P19, U1. The metric rows of several methods: of each folder metrics.csv, else metrics.json; one schema;
    the older name delta_macro_pct counts as eta2_macro_balanced_perc."""
    out = None
    for method, folder in sorted(folders.items()):
        at = first_existing([f"{folder}/metrics.csv", f"{folder}/metrics_csv", f"{folder}/metrics.json", f"{folder}/metrics_json"])
        if at is None:
            continue
        if at.endswith("csv"):  # the header names the columns; their types are METRIC_COLUMNS'
            df = spark.read.option("header", True).csv(at)
            if "eta2_macro_balanced_perc" not in df.columns and "delta_macro_pct" in df.columns:
                df = df.withColumnRenamed("delta_macro_pct", "eta2_macro_balanced_perc")
        else:
            df = spark.read.schema(METRIC_COLUMNS + ", delta_macro_pct double").option("multiLine", at.endswith(".json")).json(at)
            df = df.withColumn("eta2_macro_balanced_perc", F.coalesce("eta2_macro_balanced_perc", "delta_macro_pct"))
        df = fixed_schema(df.withColumn("method", F.lit(method)), METRIC_COLUMNS)
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], METRIC_COLUMNS)


def fixed_schema(df: DataFrame, schema: str) -> DataFrame:
    """P18. The columns of a schema in order, cast; null where df has none."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return df.select(*[(F.col(n).try_cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields])


def stop_words(path: str) -> list[str]:
    """S14. One word a line, lower case; blank lines and lines with # are left out."""
    lines = (x.strip().lower() for x in files.read_text(path).splitlines())
    return sorted({x for x in lines if x and not x.startswith("#")})


def read_config(path: str) -> dict:
    """S15. A nested configuration as one level of dotted names; JSON, or YAML where a parser is installed."""
    text = files.read_text(path)
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML needs the yaml package; use JSON") from e
        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    return flatten(data or {})


def flatten(data: dict, before: str = "") -> dict:
    out: dict = {}
    for k, v in data.items():
        out |= flatten(v, f"{before}{k}.") if isinstance(v, dict) else {f"{before}{k}": v}
    return out


def read_model(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """S16. Prototype tables (id, vec) by name, and the parameters, of a model folder."""
    params = json.loads(files.read_text(f"{folder}/params.json"))
    return {n: spark.read.parquet(f"{folder}/{n}") for n in params["tables"]}, params["params"]


def theme_table(df: DataFrame, provenance: str | None = None) -> DataFrame:
    """S17. Themes with a summary, the first of each z_id by summary; with provenance only rows of that origin, and an error if there are none."""
    required(df, ["z_id", "theme_summary"])
    rows = df.where(F.trim("theme_summary") != "")
    if provenance is not None:
        rows = rows.where(F.col("provenance") == provenance) if "provenance" in df.columns else rows.limit(0)
        if rows.isEmpty():
            raise ValueError(f"no themes of origin {provenance}")
    return first_by(rows, "z_id", F.col("theme_summary"))


def in_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """S18 to S20. Apply f to Arrow batches of rows; the hook for encoders of texts and for models."""
    return df.mapInArrow(lambda batches: (f(b) for b in batches), schema)
