"""Reports as they arrive: the same extraction over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import build_catalog
from ..sources.readers import reports_of
from ..sources.writers import write_catalog


def follow_reports(spark: SparkSession, root: str, catalog: str, checkpoint: str, tickers: DataFrame | None = None) -> StreamingQuery:
    """Append the tables of new .txt files below root to the Parquet catalog; stops once all that are there are read.

    A report is one file and so lies in one batch; each batch is extracted as a whole, and written by
    year, clustered by ticker, below a folder named by its number, so that a batch that is run again
    replaces what it wrote and readers prune by year.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(root)

    def append(batch: DataFrame, number: int) -> None:
        write_catalog(build_catalog(reports_of(batch), tickers), f"{catalog}/batch={number}")

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
