"""Connected components by frontier breadth-first search.

Each round: every node that comes before its neighbours (by degree, then hash) is a seed; all seeds expand at once along the
adjacency lists (hash-partitioned by node) until each node carries a seed's label. Where two labels meet, the pair becomes an
edge of a smaller graph between seeds; the next round works on that graph, or one task if its size is bounded
(SMALL_GRAPH). Seeds are never adjacent, so every round at least halves the nodes that still have edges; labels follow
by joins. Nothing is collected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import cut


class Joined:
    """Union-find over the links of one task."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def same(self, x, y) -> bool:
        return self.find(x) == self.find(y)

    def join(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


#: A graph of so many edges at most is joined in one task.
SMALL_GRAPH = 250_000


def components(links: DataFrame, most_rounds: int = 60, small: int = SMALL_GRAPH) -> DataFrame:
    """(node, component) of every node of links (a, b); component is one of its nodes. Nulls and loops link nothing.

    Empty links give an empty result. Works for any type of node that can be ordered.
    """
    both = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = cut(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    result = None
    for turn in range(most_rounds):
        # nodes of many neighbours come first, so that a hub takes all of them at once; then by hash
        rank = lambda n, c: F.struct(-F.floor(F.log2(n)), F.xxhash64(F.lit(turn), c).alias("h"), c.alias("x"))
        degree = edges.groupBy("a").agg(F.count("*").alias("n"))
        ranked = edges.join(degree.withColumnsRenamed({"a": "b", "n": "nb"}), "b").groupBy("a").agg(F.min(rank(F.col("nb"), F.col("b"))).alias("least"), F.count("*").alias("n"))
        # each node goes to its least neighbour; nodes that are least themselves are the seeds of this round
        seed = rank(F.col("n"), F.col("a")) < F.col("least")
        labels = cut(ranked.select(F.col("a").alias("node"), F.when(seed, F.col("a")).alias("label"), F.when(seed, F.col("a")).otherwise(F.col("least.x")).alias("to")))
        while not (waiting := labels.where("label is null")).isEmpty():
            # a node takes its target's label, or goes where the target goes
            target = labels.select(F.col("node").alias("to"), "label", F.col("to").alias("next"))
            labels = cut(labels.where("label is not null").unionByName(waiting.drop("label").join(target, "to").select("node", "label", F.col("next").alias("to"))))
        labels = labels.select("node", "label")
        result = labels if result is None else cut(followed(result, labels))
        meet = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        edges = cut(meet.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        left = edges.count()
        if left == 0:
            break
        if left <= small:
            result = followed(result, joined(edges))
            break
    else:
        raise RuntimeError("components did not settle")
    return result.select("node", F.col("label").alias("component"))


def followed(result: DataFrame, labels: DataFrame) -> DataFrame:
    """result with each label replaced by that label's own."""
    return result.withColumnRenamed("label", "mid").join(labels.select(F.col("node").alias("mid"), F.col("label").alias("next")), "mid", "left").select("node", F.coalesce("next", "mid").alias("label"))


def joined(edges: DataFrame) -> DataFrame:
    """(node, label) of a small graph, in one task."""

    def run(batches):
        union, nodes = Joined(), set()
        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                union.join(x, y)
                nodes.add(x)
        nodes = sorted(nodes)
        kind = pa.string() if nodes and isinstance(nodes[0], str) else pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([union.find(x) for x in nodes], kind)], ["node", "label"])

    t = edges.schema["a"].dataType
    kind = t if t.simpleString() == "string" else LongType()
    out = edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).coalesce(1).mapInArrow(run, f"node {kind.simpleString()}, label {kind.simpleString()}")
    return out.select(F.col("node").cast(t), F.col("label").cast(t))
