"""Problem 1: the score cutoff per source that keeps a target fraction of its records.

Method: the records are reduced to (source, score, count) and range-sorted by source and falling
score; counts per (partition, source) are prefix-summed to locate the partition that holds the
target row, and only that partition is read for the exact row. A hot source spans many range
partitions; no source is ever sorted in one task.

Edge cases: an empty input gives no rows; a null score, source or target drops the record; ties of
a score are kept or dropped together (the cutoff keeps all of them); repeated target rows count
once, with the largest target; a target of zero still keeps the top score; extra columns of the
inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import checkpointed


def fraction_cutoffs(records: DataFrame, targets: DataFrame, source: str, score: str, pct: str) -> DataFrame:
    """(source, cutoff, kept, total): the largest score so that at least pct per cent are kept.

    ``records`` has one row per record or per (source, score) with a column ``n`` of counts.
    """
    spark = records.sparkSession
    counts = F.sum("n") if "n" in records.columns else F.count(F.lit(1))
    spectrum = (
        records.filter(F.col(source).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(source).alias("src"), F.col(score).alias("score"))
        .agg(counts.alias("n"))
    )
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpointed(
        spectrum.repartitionByRange(parts, F.col("src"), F.col("score").desc())
        .sortWithinPartitions(F.col("src"), F.col("score").desc())
        .withColumn("part", F.spark_partition_id())
    )
    goal = (
        targets.filter(F.col(source).isNotNull() & F.col(pct).isNotNull())
        .groupBy(F.col(source).alias("src"))
        .agg(F.max(F.col(pct).cast("bigint")).alias("pct"))
    )
    order = Window.partitionBy("src").orderBy("part")
    per_part = ranged.groupBy("src", "part").agg(F.sum("n").alias("n"))
    located = (
        per_part.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy("src")))
        .join(goal, "src")
        # the smallest count c with 100 * c >= pct * total
        .withColumn("need", F.greatest(F.lit(1).cast("bigint"), F.expr("(pct * total + 99) div 100")))
        .withColumn("before", F.col("upto") - F.col("n"))
        .filter((F.col("before") < F.col("need")) & (F.col("need") <= F.col("upto")))
        .select("src", "part", "before", "need", "total")
    )
    run = Window.partitionBy("src").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(located, ["src", "part"])
        .withColumn("kept", F.col("before") + F.sum("n").over(run))
        .filter((F.col("kept") >= F.col("need")) & (F.col("kept") - F.col("n") < F.col("need")))
        .select(F.col("src").alias(source), F.col("score").alias("cutoff"), "kept", "total")
    )


def file_languages(quality: DataFrame) -> DataFrame:
    """(file, language): the non-null language of the file's latest check; equal times: the last by name."""
    return (
        quality.filter(F.col("file").isNotNull() & F.col("language").isNotNull())
        .groupBy("file")
        .agg(F.max(F.struct("checked_at", "language")).alias("last"))
        .select("file", F.col("last.language").alias("language"))
    )


def line_cutoffs(raw_freq: DataFrame, quality: DataFrame, keep_targets: DataFrame) -> DataFrame:
    """(language, cutoff, kept, total) over distinct lines (file, ord) with a frequency of 1 or more.

    A line delivered again counts once (with its largest frequency should they differ). Lines are
    deduplicated on (file, ord), so that a large file is spread over all tasks, and then counted per
    (file, frequency) before they meet the languages.
    """
    spectrum = (
        raw_freq.filter((F.col("frequency") >= 1) & F.col("file").isNotNull())
        .groupBy("file", "ord")
        .agg(F.max("frequency").alias("frequency"))
        .groupBy("file", "frequency")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    lines = spectrum.join(file_languages(quality), "file").select("language", "frequency", "n")
    return fraction_cutoffs(lines, keep_targets, "language", "frequency", "target_pct")
