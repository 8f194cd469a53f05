"""Sinks: metric rows, vectors, logs, models, network files, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files


def write_metrics(df: DataFrame, folder: str) -> None:
    """K1. One metric table as JSON lines and as CSV with header."""
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics_json")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/metrics_csv")


def wide_vectors(df: DataFrame, n: int, name: str = "embedding", first: int = 1, width: int = 0) -> DataFrame:
    """K3. doc_id and dim_* columns from an array, numbered from first, padded to width."""
    return df.select("doc_id", *[F.get(F.col(name), F.lit(i)).cast("float").alias(f"dim_{i + first:0{width}d}") for i in range(n)])


def append_log(df: DataFrame, path: str) -> None:
    """K4, K5. Append log rows as JSON lines, or as CSV where the path says so; each CSV file has its own header, and readers of
    the folder skip it."""
    w = df.write.mode("append")
    w.option("header", True).csv(path) if path.endswith("csv") else w.json(path)


def write_model(tables: dict[str, DataFrame], params: dict, folder: str) -> None:
    """K2, K7. Prototype tables as Parquet, parameters as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    files.write_text(f"{folder}/params.json", json.dumps({"tables": sorted(tables), "params": params}, ensure_ascii=False, indent=1))


def write_config(config: dict, path: str) -> None:
    """K6. The resolved configuration."""
    files.write_text(path, json.dumps(config, ensure_ascii=False, indent=1, sort_keys=True))


def bif_text(nodes: dict[str, list[str]], cpds: list[tuple[str, list[str], dict[tuple, list[float]]]], name: str = "network") -> str:
    """K8. A network in the BIF interchange format. cpds: (node, parents, {parent states: probabilities})."""
    out = [f"network {name} {{", "}"]
    for node, states in sorted(nodes.items()):
        out += [f"variable {node} {{", f"  type discrete [ {len(states)} ] {{ {', '.join(states)} }};", "}"]
    for node, parents, table in cpds:
        out.append(f"probability ( {node}{' | ' + ', '.join(parents) if parents else ''} ) {{")
        for given, p in sorted(table.items()):
            values = ", ".join(f"{x:.6f}" for x in p)
            out.append(f"  ({', '.join(map(str, given))}) {values};" if parents else f"  table {values};")
        out.append("}")
    return "\n".join(out) + "\n"


def markdown(df: DataFrame, most: int = 200) -> str:
    """K10. A small table as Markdown, numbers to four places; beyond `most` rows an error, as reports are small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    show = lambda x: "n/a" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"


def latex(df: DataFrame, most: int = 200) -> str:
    """K11. A small table as a LaTeX tabular; beyond `most` rows an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    plain = lambda x: "--" if x is None else f"{x:.3f}" if isinstance(x, float) else "".join("\\" + c if c in "&%$#_{}" else c for c in str(x))
    body = [" & ".join(map(plain, r)) + r" \\" for r in [df.columns, *rows]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", body[0], r"\hline", *body[1:], r"\end{tabular}"]) + "\n"


def write_report(mapping: DataFrame, report: DataFrame, folder: str) -> None:
    """K9. A two-part report: tables `mapping` and `late_report` of one folder."""
    write_table(mapping, f"{folder}/mapping")
    write_table(report, f"{folder}/late_report")


def cpd_rows(tables: DataFrame, folder: str) -> None:
    """K8. Conditional probability tables (node, given, state, p) as Parquet and as CSV with header."""
    write_table(tables, f"{folder}/cpd")
    tables.orderBy("node", "given", "state").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/cpd_csv")  # a network's tables


def write_table(df: DataFrame, path: str, *partition: str) -> None:
    """K9, K14, K15. A result table as Parquet."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


class Layout:
    """K16. Where the results of a method are: root/method/kind, with older names mapped to the present ones."""

    OLD = {"out": "exports", "embeddings": "vectors", "figs": "figures"}

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def of(self, method: str, kind: str) -> str:
        return f"{self.root}/{method}/{self.OLD.get(kind, kind)}"
