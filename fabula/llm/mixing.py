"""Mixing sources to target weights (p9): subset-sum budget fitting on counts of documents by exact token length.

A source's share of the budget is first filled by whole uses of the source, then by a subset of its documents used once
more: of every length the proportional part, and the rest of the budget by a bounded knapsack over the lengths left.
Documents of a length are selected by seeded hash. Work on lengths is per source and never sees single documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import DEFAULT_PATH, token_counts
from .wordsets import mix as scramble

CELLS = 64
#: The knapsack fills what is left of a budget below so many of the longest documents.
REST = 8


def knapsack(room: int, lengths: list[int], counts: list[int]) -> dict[int, int]:
    """How many of each length sum up to the most that is at most room. Bits of a whole number are the reachable sums."""
    reach, items, steps = 1, [], []
    mask = (1 << (room + 1)) - 1
    for length, count in zip(lengths, counts):
        count, k = min(count, room // length if length else 0), 1
        while count > 0 and not reach >> room & 1:
            k = min(k, count)
            steps.append(reach)
            items.append((length, k))
            reach |= (reach << length * k) & mask
            count -= k
            k *= 2
    best, out = reach.bit_length() - 1, {}
    for (length, k), before in zip(reversed(items), reversed(steps)):
        if not before >> best & 1:
            out[length] = out.get(length, 0) + k
            best -= length * k
    return out


def fill(goal: float, lengths: np.ndarray, counts: np.ndarray, max_uses: int, seed: int) -> tuple[int, np.ndarray]:
    """(uses of every document, documents of each length that are used once more) for a goal in tokens."""
    extra = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if total <= 0 or goal <= 0 or max_uses <= 0:
        return 0, extra
    uses = int(goal // total)
    if uses >= max_uses:
        return max_uses, extra
    room = int(goal - uses * total)
    extra = np.floor(counts * (room / total)).astype(np.int64)
    room -= int((extra * lengths).sum())
    order = np.argsort(scramble(lengths.astype(np.uint64), seed), kind="stable")
    order = order[lengths[order] > 0]
    # one more of each length by turns, while far from the goal
    edge = REST * int(lengths.max())
    for i in order:
        if room <= edge:
            break
        if extra[i] < counts[i] and lengths[i] <= room:
            extra[i] += 1
            room -= int(lengths[i])
    left = counts - extra
    use = [i for i in order if left[i] > 0 and lengths[i] <= room]
    chosen = knapsack(room, [int(lengths[i]) for i in use], [int(left[i]) for i in use])
    at = {int(lengths[i]): i for i in use}
    for length, k in chosen.items():
        extra[at[length]] += k
    return uses, extra


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 1, path: str = DEFAULT_PATH) -> tuple[DataFrame, DataFrame]:
    """(draws, report): draws (mix_id, source, doc_id, uses); report (mix_id, source, goal_tokens, source_tokens,
    drawn_tokens, target_share, actual_share, residual, short).

    docs: doc_id, text, source; targets: mix_id, source, target_weight, max_uses, budget_tokens. The goal of a source is
    target_weight x budget_tokens; residual is what the draw lacks of it; short says that the draw lacks tokens though it
    uses every document max_uses times. Null parts of a target count as zero; sources without documents hold none; documents with null source
    belong to none; a doc_id delivered again counts once, and one without id is left out; empty texts are never drawn. actual_share is a source's
    share of all tokens drawn for the mix (null if none). Empty tables give empty results or a report of nothing drawn.
    """
    unique = docs.where("doc_id is not null and source is not null")
    sized = token_counts(unique.select("doc_id", "source", "text"), ["doc_id", "source"], path)
    sized = cut(sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("m")).select("doc_id", F.col("m.source").alias("source"), F.col("m.tokens").alias("tokens")))
    cells = sized.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(CELLS)).cast("int"))
    lengths = sized.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    goals = targets.where("mix_id is not null and source is not null").select("mix_id", "source", (F.coalesce("target_weight", F.lit(0.0)) * F.coalesce("budget_tokens", F.lit(0))).alias("goal"), F.coalesce("max_uses", F.lit(0)).alias("max_uses"), F.coalesce("target_weight", F.lit(0.0)).alias("target_share"))

    def plan(pdf: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.tokens > 0].sort_values("tokens")
        size, count = pdf.tokens.to_numpy(np.int64), pdf.n.to_numpy(np.int64)
        out = {k: [np.empty(0, np.int64)] for k in ("mix_id", "tokens", "uses", "extra")}
        source: list[str] = []
        for w in wanted.itertuples(index=False):
            uses, extra = fill(float(w.goal), size, count, int(w.max_uses), seed + int(w.mix_id))
            keep = (uses > 0) | (extra > 0)
            n = int(keep.sum())
            source += [str(w.source)] * n
            for k, v in (("mix_id", np.full(n, w.mix_id)), ("tokens", size[keep]), ("uses", np.full(n, uses)), ("extra", extra[keep])):
                out[k].append(v.astype(np.int64))
        done = {k: np.concatenate(v) for k, v in out.items()}
        return pd.DataFrame({"mix_id": done["mix_id"].astype(np.int32), "source": np.array(source, object), "tokens": done["tokens"], "uses": done["uses"].astype(np.int32), "extra": done["extra"]}).astype({"source": object})

    plans = cut(lengths.groupBy("source").cogroup(goals.groupBy("source")).applyInPandas(plan, "mix_id int, source string, tokens long, uses int, extra long"))
    # place of a document among those of its source and length, by hash: cells first, so that no group is sorted in one task
    before = cells.groupBy("source", "tokens", "cell").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("source", "tokens").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("source", "tokens", "cell").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    placed = cells.withColumn("inside", inside).join(before, ["source", "tokens", "cell"]).withColumn("place", F.col("inside") + F.col("before")).select("doc_id", "source", "tokens", "place")
    draws = placed.join(plans, ["source", "tokens"]).withColumn("uses", F.col("uses") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)).where("uses > 0").select("mix_id", "source", "doc_id", F.col("uses").cast("int").alias("uses"))
    held = lengths.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("source_tokens"))
    drawn = plans.join(lengths, ["source", "tokens"]).groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * (F.col("uses") * F.col("n") + F.col("extra"))).alias("drawn_tokens"))
    report = goals.join(held, "source", "left").join(drawn, ["mix_id", "source"], "left").fillna(0, ["source_tokens", "drawn_tokens"])
    total = F.sum("drawn_tokens").over(Window.partitionBy("mix_id"))
    report = report.select("mix_id", "source", F.col("goal").alias("goal_tokens"), "source_tokens", "drawn_tokens", "target_share", F.try_divide(F.col("drawn_tokens"), total).alias("actual_share"), (F.col("goal") - F.col("drawn_tokens")).alias("residual"), ((F.col("drawn_tokens") < F.col("goal")) & (F.col("drawn_tokens") == F.col("source_tokens") * F.greatest("max_uses", F.lit(0)))).alias("short"))
    return draws, report
