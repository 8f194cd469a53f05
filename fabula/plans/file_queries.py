"""Round trips through sources and sinks, in the shared folder: written, read back, and compared with what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, network
from ..session import ensure_checkpoint_dir
from ..sources import files, readers, sinks
from .network_queries import CHAIN, CPD, FOLDS, NET, _chain, _folds
from .registry import query
from .tables import UNITS, VECTORS, labelled, rounded, table, units, vectors


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "line int, text string")


def _eta_sql() -> str:
    from .vector_queries import ETA, LONG

    one = "round(least(greatest(1 - wbal / (tbal + 1e-12), 0), 1), 6)"
    return f"with {LONG}, {ETA} select m \"method\", n, {one} eta2_macro_balanced, round(100 * {one}, 4) eta2_macro_balanced_perc from eta, (select unnest(['as_csv', 'as_json', 'older']) m)"


@query(_eta_sql())
def metric_files(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows written as CSV and JSON, and one with the older column name, read as one table."""
    at = _folder(spark, "metrics")
    e = rounded(geometry.eta2(labelled(spark, sf)))
    row = readers.fixed_schema(e.withColumnRenamed("n", "n_total"), readers.METRIC_COLUMNS)
    sinks.write_metrics(row, f"{at}/as_csv")
    row.select("n_total", "eta2_macro_balanced", F.col("eta2_macro_balanced_perc").alias("delta_macro_pct")).coalesce(1).write.json(f"{at}/older/metrics_json")
    row.coalesce(1).write.json(f"{at}/as_json/metrics_json")
    m = readers.metric_rows(spark, {k: f"{at}/{k}" for k in ("as_csv", "as_json", "older", "missing")})
    return m.select("method", F.col("n_total").alias("n"), F.round("eta2_macro_balanced", 6).alias("eta2_macro_balanced"), F.round("eta2_macro_balanced_perc", 4).alias("eta2_macro_balanced_perc"))


@query(f"with {UNITS} select doc_id, accident_id, nullif(sentence, '') sentence, pred_label, macro_id::int macro_id from units")
def unit_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Units as CSV with header, found by candidate paths and read with a schema; CSV doesn't tell empty texts from nulls."""
    at = _folder(spark, "units")
    out = units(spark, sf).select("doc_id", "accident_id", F.lit(None).cast("int").alias("fact_id"), "sentence", F.lit(None).cast("string").alias("accident_summary"), "pred_label", "pred_subtype", "pred_confidence", F.lit("true").alias("pred_ok"), "division", F.lit(None).cast("string").alias("equipment_involved"), "company_code")
    out.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{at}/units.csv")
    found = readers.first_existing([f"{at}/none.csv", f"{at}/un*.csv"])
    df = readers.labelled_units(readers.read_table(spark, found, readers.UNIT_SCHEMA))
    return df.select("doc_id", "accident_id", "sentence", "pred_label", F.col("macro_id").cast("int").alias("macro_id"))


@query(f"with {VECTORS} select doc_id, round(list_sum(list_transform(v, lambda x: x::float::double)), 4) total, round(v[64], 5) last from vectors")
def vector_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as wide CSV, found by their header below a folder."""
    at = _folder(spark, "vectors")
    v = vectors(spark, sf).drop("corpus")
    dims = readers.dim_columns(v)
    spark.createDataFrame([("x",)], "name string").coalesce(1).write.option("header", True).csv(f"{at}/a.csv")
    sinks.wide_vectors(readers.as_array(v), 64).write.option("header", True).csv(f"{at}/b/vectors.csv")
    found = readers.find_vectors(at).rsplit("/", 1)[0]
    back = readers.usable_vectors(readers.read_table(spark, found, "doc_id long, " + ", ".join(f"{c} float" for c in dims)))
    return rounded(back.select("doc_id", F.round(sum((F.col(c).cast("double") for c in dims), F.lit(0.0)), 4).alias("total"), F.round(F.col("dim_64").cast("double"), 5).alias("last")), 5)


@query(f"with {FOLDS}, l as (select fold_id metric, 1 epoch, round(confidence, 6) \"value\" from f union all select fold_id, 2, round(confidence + 1, 6) from f) select metric, epoch, \"value\" from l")
def log_json(spark: SparkSession, sf: str) -> DataFrame:
    """K4: a log appended twice."""
    at = _folder(spark, "log") + "/log.jsonl"
    rows = _folds(spark, sf).select(F.col("fold_id").alias("metric"), F.lit(1).alias("epoch"), F.round("confidence", 6).alias("value"))
    sinks.append_log(rows, at)
    sinks.append_log(rows.select("metric", F.lit(2).alias("epoch"), F.round(F.col("value") + 1, 6).alias("value")), at)
    return readers.read_table(spark, at, "metric string, epoch int, value double")


@query(f"with {FOLDS} select fold_id metric, round(confidence + 1, 6) \"value\" from f")
def log_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A log appended twice as CSV, each file with a header; the last value of each metric."""
    at = _folder(spark, "log") + "/log.csv"
    rows = _folds(spark, sf).select(F.col("fold_id").alias("metric"), F.lit(1).alias("epoch"), F.round("confidence", 6).alias("value"))
    sinks.append_log(rows, at)
    sinks.append_log(rows.select("metric", F.lit(2).alias("epoch"), F.round(F.col("value") + 1, 6).alias("value")), at)
    from ..operators.splits import last_values

    return last_values(readers.read_table(spark, at, "metric string, epoch int, value double"))


@query(f"with {VECTORS}, m as (select doc_id id, [v[1], v[2]] v from vectors) select id, round(v[1], 6) x, round(v[2], 6) y, 0.1::double temperature, 2 tables from m")
def model_files(spark: SparkSession, sf: str) -> DataFrame:
    """Prototype tables and parameters of a model folder."""
    at = _folder(spark, "model")
    v = readers.as_array(vectors(spark, sf).drop("corpus")).select(F.col("doc_id").alias("id"), F.slice("embedding", 1, 2).alias("vec"))
    sinks.write_model({"topics": v, "labels": v.limit(0)}, {"temperature": 0.1}, at)
    tables, params = readers.read_model(spark, at)
    return rounded(tables["topics"].select("id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"), F.lit(params["temperature"]).alias("temperature"), F.lit(len(tables)).alias("tables")))


@query("select * from (values ('a.b', '1'), ('a.c.d', 'x'), ('e', 'None')) t(name, \"value\")")
def config_file(spark: SparkSession, sf: str) -> DataFrame:
    """A nested configuration, written, read and flattened."""
    at = _folder(spark, "config") + "/resolved.json"
    sinks.write_config({"a": {"b": 1, "c": {"d": "x"}}, "e": None}, at)
    return spark.createDataFrame([(k, str(v)) for k, v in readers.read_config(at).items()], "name string, value string")


@query("select unnest(['alors', 'chantier', 'puis']) word")
def stop_word_file(spark: SparkSession, sf: str) -> DataFrame:
    """S14, U2."""
    at = _folder(spark, "words") + "/stop.txt"
    files.write_text(at, "# words\n\nPuis\n chantier \npuis\nalors\n")
    return spark.createDataFrame([(w,) for w in readers.stop_words(at)], "word string")


@query("select 'documents.parquet' present, 'gone.parquet' missing, 'text' text_column, 'doc_id,text' columns")
def source_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Files and columns that must be there."""
    d = table(spark, sf, "documents")
    readers.check_files(sf, ["documents.parquet"])
    try:
        readers.check_files(sf, ["documents.parquet", "gone.parquet"])
        missing = ""
    except FileNotFoundError as e:
        missing = str(e).rsplit(" ", 1)[-1]
    cols = ",".join(readers.available(readers.required(d, ["doc_id"]), ["doc_id", "none", "text"]).columns)
    return spark.createDataFrame([("documents.parquet", missing, readers.text_column(d), cols)], "present string, missing string, text_column string, columns string")


@query(f"with {NET}, {CPD} select node, coalesce(given, '') given, s::int state, round(p, 6) p from cp")
def cpd_files(spark: SparkSession, sf: str) -> DataFrame:
    """K8: conditional tables as Parquet and CSV."""
    at, m, out = _folder(spark, "cpd"), _chain(spark, sf), None
    for i, node in enumerate(CHAIN):
        t = network.conditional_table(m, node, CHAIN[i - 1 : i] if i else [])
        t = t.select(F.lit(node).alias("node"), (F.col(CHAIN[i - 1]).cast("string") if i else F.lit("")).alias("given"), F.col(node).cast("int").alias("state"), "p")
        out = t if out is None else out.unionByName(t)
    sinks.cpd_rows(rounded(out), at)
    back = spark.read.option("header", True).schema("node string, given string, state int, p double").csv(f"{at}/cpd_csv")
    return back.join(spark.read.parquet(f"{at}/cpd").select("node", F.coalesce(F.nullif("given", F.lit("")), F.lit("")).alias("given"), "state"), ["node", "state"], "left_semi").select("node", F.coalesce("given", F.lit("")).alias("given"), "state", "p")


@query("""select * from (values (1, 'network n {'), (2, '}'), (3, 'variable a {'), (4, '  type discrete [ 2 ] { no, yes };'), (5, '}'), (6, 'variable b {'), (7, '  type discrete [ 2 ] { no, yes };'), (8, '}'),
    (9, 'probability ( a ) {'), (10, '  table 0.250000, 0.750000;'), (11, '}'), (12, 'probability ( b | a ) {'), (13, '  (no) 0.500000, 0.500000;'), (14, '  (yes) 0.100000, 0.900000;'), (15, '}')) t(line, text)""")
def bif_lines(spark: SparkSession, sf: str) -> DataFrame:
    """K8: the interchange text of a network."""
    return _lines(spark, sinks.bif_text({"a": ["no", "yes"], "b": ["no", "yes"]}, [("a", [], {(): [0.25, 0.75]}), ("b", ["a"], {("no",): [0.5, 0.5], ("yes",): [0.1, 0.9]})], "n"))


@query(f"with {FOLDS}, r as (select fold_id, confidence, row_number() over (order by fold_id) n from f) select 1 line, '| fold_id | confidence |' text union all select 2, '| --- | --- |' union all select (n + 2)::int, '| ' || fold_id || ' | ' || printf('%.4f', round(confidence, 6)) || ' |' from r where n <= 20")
def markdown_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 runs, a report."""
    return _lines(spark, sinks.markdown(rounded(_folds(spark, sf).select("fold_id", "confidence").orderBy("fold_id").limit(20))))


@query(f"with {FOLDS}, r as (select fold_id, confidence, row_number() over (order by fold_id) n from f), k as (select least(count(*), 20) k from f) select 1 line, '\\begin{{tabular}}{{ll}}' text union all select 2, 'fold\\_id & confidence \\\\' union all select 3, '\\hline' union all select (n + 3)::int, replace(fold_id, '_', '\\_') || ' & ' || printf('%.3f', round(confidence, 6)) || ' \\\\' from r where n <= 20 union all select (k + 4)::int, '\\end{{tabular}}' from k")
def latex_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 runs, a report."""
    return _lines(spark, sinks.latex(rounded(_folds(spark, sf).select("fold_id", "confidence").orderBy("fold_id").limit(20))))


@query(f"with {FOLDS} select fold_id, round(confidence, 6) confidence, n, 'mapping' part from f union all select fold_id, round(confidence, 6), n, 'late_report' from f where n > 1")
def report_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A two-part report and result tables, under the layout's present name for an older one."""
    at = sinks.Layout(_folder(spark, "reports")).of("supcon", "out")
    f = rounded(_folds(spark, sf))
    sinks.write_report(f, f.where("n > 1"), at)
    if not at.endswith("/supcon/exports"):
        raise ValueError(at)
    parts = [spark.read.parquet(f"{at}/{p}").withColumn("part", F.lit(p)) for p in ("mapping", "late_report")]
    return parts[0].unionByName(parts[1])
