"""New pairs of editions as they arrive: each micro-batch is compared like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stemma.editions import compare

PARAGRAPHS = "pair_id string, edition string, sec_ix int, section_id string, title string, level int, par_ix int, n0 string"


def compare_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parquet files of complete pairs below `source`; changes go to `target`, a folder per batch.

    A batch that is repeated after a failure overwrites its own folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        compare(batch).changes.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(PARAGRAPHS).parquet(source).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
