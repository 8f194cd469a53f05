"""Times plain NumPy and pandas versions of three queries at $BENCH_SF_DIR in one process, and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pandas as pd

DIMS = [f"dim_{i}" for i in range(1, 65)]
MACROS = ["A0", "A1", "B", "C"]
RANKS = {"NONE": 0, "MINOR": 1, "HOSPITALIZED": 2, "FATAL": 3}


def labelled(sf: str) -> tuple[np.ndarray, np.ndarray]:
    units = pd.read_parquet(f"{sf}/data_btp.parquet", columns=["doc_id", "pred_label", "pred_ok", "loaded_at", "pred_confidence"])
    ok = units.pred_ok.str.strip().str.lower().isin(["true", "1", "yes", "t"])
    units = units[ok & units.pred_label.isin(MACROS) & units.doc_id.notna()].sort_values(["doc_id", "loaded_at", "pred_confidence"]).drop_duplicates("doc_id")
    wide = pd.read_parquet(f"{sf}/qwen3_embedding.parquet", columns=["doc_id", *DIMS])
    x = wide[DIMS].to_numpy(np.float64)
    length = (x * x).sum(1)
    wide = wide[np.isfinite(length) & (length > 0) & wide.doc_id.notna()].sort_values(["doc_id", *DIMS]).drop_duplicates("doc_id")
    both = units.merge(wide, on="doc_id")
    return both.pred_label.to_numpy(), both[DIMS].to_numpy(np.float64)


def geometry(sf: str) -> dict:
    label, x = labelled(sf)
    means = {m: x[label == m].mean(0) for m in MACROS}
    within = {m: ((x[label == m] - means[m]) ** 2).sum(1).mean() for m in MACROS}
    middle = np.mean(list(means.values()), axis=0)
    total = np.mean([((x[label == m] - middle) ** 2).sum(1).mean() for m in MACROS])
    return {"eta2_macro_balanced": 1 - np.mean(list(within.values())) / total}


def matrix(sf: str) -> pd.DataFrame:
    p = pd.read_parquet(f"{sf}/metadata_with_malt_predictions.parquet")
    p = p[p.doc_id.notna()].drop_duplicates("doc_id")
    p = p[p.z_hat >= 0]
    digits = p.accident_id.str.replace("[^0-9]", "", regex=True)
    p = p.assign(accident_id=digits.where(digits.str.len() == 9), rank=p.pred_severity.str.strip().str.upper().map(RANKS).fillna(0)).dropna(subset=["accident_id"])
    sure = p[p.z_confidence >= 0.5]
    support = sure.groupby("z_hat").accident_id.nunique().rename("support").reset_index()
    macro = p.dropna(subset=["z_dominant_macro"]).groupby("z_hat").z_dominant_macro.agg(lambda s: s.mode().min()).rename("macro").reset_index()
    kept = support.merge(macro, on="z_hat")
    kept = kept[kept.support >= 5].sort_values(["macro", "support", "z_hat"], ascending=[True, False, True]).groupby("macro").head(6)
    kept["variable"] = [f"Z_{int(z):02d}_{m}" for z, m in zip(kept.z_hat, kept.macro)]
    long = sure.merge(kept[["z_hat", "variable"]], on="z_hat")[["accident_id", "variable"]].drop_duplicates()
    wide = pd.crosstab(long.accident_id, long.variable).reindex(p.accident_id.unique(), fill_value=0)
    return wide.join(p.groupby("accident_id")["rank"].max().rename("severity"))


def scenarios(sf: str) -> pd.DataFrame:
    wide = matrix(sf)
    names = sorted(c for c in wide if c.startswith("Z_"))
    key = wide[names].apply(lambda r: "+".join(n for n, v in zip(names, r) if v), axis=1)
    return (wide.severity >= 2).groupby(key).agg(["size", "mean"]).sort_values("size", ascending=False).head(30)


def main() -> None:
    sf, times = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), {}
    for name, f in (("eta2_geometry", geometry), ("accident_matrix_long", matrix), ("scenarios_frequent", scenarios)):
        best = None
        for _ in range(2):
            t = time.perf_counter()
            f(sf)
            spent = time.perf_counter() - t
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "single_process_seconds", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
