"""An extension beyond the batch operators: score a stream of vectors with frozen prototypes.

Stateless: each micro-batch gets the topic of highest posterior; the sink is a folder of Parquet files, or a callback.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import argmax
from ..operators.posterior import scored


def assign(vectors: DataFrame, prototypes: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(doc_id, z_hat, z_confidence) of a batch or stream of (doc_id, embedding)."""
    rows = scored(vectors, prototypes, temperature)
    return rows.select("doc_id", F.get("p_ids", argmax(F.col("p"))).alias("z_hat"), F.array_max("p").alias("z_confidence"))


def start(stream: DataFrame, prototypes: DataFrame, checkpoint: str, path: str | None = None, each: Callable[[DataFrame, int], None] | None = None, temperature: float = 0.1) -> StreamingQuery:
    """Start scoring; exactly one of path (Parquet) and each (called with every micro-batch) is given. Prototypes are read
    once: they are written out as literals of the plan, a row a topic."""
    rows = [(r["id"], [float(x) for x in r["vec"]]) for r in prototypes.select("id", "vec").collect()]  # a row a topic
    fixed = stream.sparkSession.createDataFrame(rows, prototypes.select("id", "vec").schema)

    def write(batch: DataFrame, number: int) -> None:
        out = assign(batch, fixed, temperature)
        if each is not None:
            each(out, number)
        else:
            out.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
