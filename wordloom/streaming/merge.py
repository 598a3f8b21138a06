"""Incremental merging of frequency lists: each new line is added once, and only what changes is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.functions.text import clean_word
from wordloom.session import checkpointed

#: Folders of the result, by a hash of language and word; a run rewrites those that it changes.
BUCKETS = 64
_SCHEMA = "lang string, word string, frequency bigint, batch bigint, bucket int"


def streamed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new Parquet files of raw lines."""
    schema = "row_id bigint, file string, lang string, ord bigint, word string, frequency bigint, loaded_at timestamp"
    return spark.readStream.schema(schema).parquet(folder)


def _added(batch: DataFrame, number: int, target: str) -> None:
    """Adds a batch's sums to the buckets they belong to; buckets that have the batch already stay as they are."""
    spark = batch.sparkSession
    word = clean_word(F.col("word"))
    sums = batch.select(F.substring("file", 1, 3).alias("lang"), word.alias("word"), "frequency").filter(F.col("word").isNotNull())
    new = sums.groupBy("lang", "word").agg(F.sum("frequency").alias("frequency"))
    new = checkpointed(new.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)).cast("int")))
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    old = spark.read.schema(_SCHEMA).parquet(target) if exists else spark.createDataFrame([], _SCHEMA)
    # at most BUCKETS rows
    changed = F.broadcast(new.select("bucket").distinct())
    held = old.join(changed, "bucket", "left_semi")
    done = held.filter(F.col("batch") >= number).select("bucket").distinct()
    rows = held.select("lang", "word", "frequency", "bucket").unionByName(new.select("lang", "word", "frequency", "bucket"))
    total = rows.groupBy("lang", "word", "bucket").agg(F.sum("frequency").alias("frequency")).withColumn("batch", F.lit(number).cast("bigint"))
    kept = checkpointed(total.join(F.broadcast(done), "bucket", "left_anti"))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)


def merge_new_files(lines: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Sums per language and word over all files so far; ends when all files are read.

    A line delivered again (same file, place, word and frequency) is added once.
    """
    usable = lines.filter(F.col("word").isNotNull() & F.col("file").isNotNull() & (F.col("frequency") >= 1))
    once = usable.select("file", "ord", "word", "frequency").dropDuplicates()
    write = lambda batch, number: _added(batch, number, target)
    return once.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
