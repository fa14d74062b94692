"""Files converted once each, as they arrive, with a ledger of what came of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators import joins
from leafmill.sources import containers

LEDGER = "source string, status string, reason string, timestamp timestamp"


def convert_new(spark: SparkSession, source: str, out: str, checkpoint: str, glob: str = "*") -> StreamingQuery:
    """Convert what is new below ``source`` and stop; run it again for what comes later.

    Blocks go to ``out``/blocks, a row for each file to ``out``/ledger.  The
    checkpoint remembers files, so a run that dies goes on where it was.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(source)

    def keep(batch: DataFrame, number: int) -> None:
        blocks = containers.file_blocks(batch).withColumn("batch", F.lit(number))
        blocks.write.mode("overwrite").parquet(f"{out}/blocks/batch={number}")
        made = spark.read.parquet(f"{out}/blocks/batch={number}")
        made.groupBy(F.col("path").alias("source")).agg(F.first("status").alias("status"), F.first("reason").alias("reason")).withColumn("timestamp", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/ledger/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed by the watermark: for streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def pending(inputs: DataFrame, ledger: DataFrame) -> DataFrame:
    return joins.not_done(inputs, ledger, "source")
