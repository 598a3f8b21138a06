"""Problem 6: records that are the same but for white space, letter case, punctuation or field order.

Method: each record gets a canonical key; records are range-partitioned and sorted by (key, id) in
spillable sorts, and adjacent rows are compared by their full keys. The first row of a run stands for
it. The id is part of the sort order, so a key that holds a third of all rows is spread over many
ranges; a run that crosses a range takes its representative from the range before, for which one
summary row per range goes through the driver.

Edge cases: null or blank texts are left out, as are words with nothing left; rows with a null file
or frequency are no copies of anything; an empty table gives no rows; equal ids count once each as
rows of the run; extra columns are ignored; texts of any length are compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.encoding_repair import judged_words, lang_of, unusual
from wordloom.session import checkpointed, stored

#: The labels of the four fields of a raw line.
LABELS = ("word", "frequency", "source", "year")
_SEP = "\x1f"


def bare(text: Column) -> Column:
    """Text without white space and punctuation, letter case ignored."""
    return F.replace(F.lower(F.regexp_replace(text, r"[\p{P}\p{IsWhite_Space}]+", "")), F.lit("ς"), F.lit("σ"))


def bare_word(word: Column) -> Column:
    """As ``bare``, where most texts are ASCII letters and digits only."""
    return F.when((F.octet_length(word) == F.length(word)) & word.rlike(r"\A[A-Za-z0-9]+\z"), F.lower(word)).otherwise(bare(word))


def word_keys(raw_freq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tbl, file, key, id, lang, word) of each row, and the (lang, word) of problems 2 and 4, whose rows are to be left out.

    The key is the frequency and the bare word; lang and word are null where a word is plainly usual.
    """
    _, frame, verdicts = judged_words(raw_freq)
    rows = raw_freq.filter(F.col("word").isNotNull() & F.col("file").isNotNull() & F.col("frequency").isNotNull()).select(
        F.col("row_id").alias("id"), "file", lang_of().alias("lang"), "frequency", "word"
    )
    # one row per language
    marked = rows.join(F.broadcast(frame), "lang", "left").withColumn("odd", F.coalesce(unusual(F.col("word"), capitals=True), F.lit(False)))
    # something is left of the word; its bare form would be made twice in a filter
    keyed = marked.filter(F.col("word").rlike(_ANYTHING)).withColumn("bare", bare_word(F.col("word")))
    key = F.concat_ws(_SEP, F.col("frequency").cast("string"), "bare").alias("key")
    keyed = keyed.select(F.lit("raw_freq").alias("tbl"), "file", key, "id", *(F.when(F.col("odd"), F.col(c)).alias(c) for c in ("lang", "word")))
    return keyed, verdicts.filter(F.col("kind").isNotNull()).select("lang", "word")


#: Signs between the fields of a line without labels; the first that gives four fields counts.
SIGNS = ("|", ";", "/", ",", "\t")
_ANYTHING = r"[^\p{P}\p{IsWhite_Space}]"  # what ``bare`` leaves something of


def _line_text(line: Column) -> Column:
    return F.regexp_replace(line, r"\A\p{IsWhite_Space}+|[\p{IsWhite_Space}.,;]+\z", "")


def _named_fields(text: Column) -> Column:
    """The bare labelled fields of a text that begins with a label, after an empty one."""
    label = rf"({'|'.join(LABELS)})\p{{IsWhite_Space}}*[=:]"
    between = r"\p{IsWhite_Space}*[,;|/\t]\p{IsWhite_Space}*"
    fields = F.split(bare(F.regexp_replace(text, rf"(?i)(?:\A|{between}){label}", f"{_SEP}$1=")), _SEP)
    return F.when(text.rlike(rf"(?i)\A{label}"), fields)


def line_key(text: Column, named: Column) -> Column:
    """The four fields of a line in one order, without labels, layout, case, white space and punctuation.

    Labelled fields are ordered by label, others by value. A line that has no four fields is its own
    bare text. Fields are made bare together: ``bare`` leaves the sign between them alone.
    """
    sign = F.lit(None).cast("string")
    for ch in reversed(SIGNS):
        sign = F.when(text.rlike(rf"\A(?:[^{ch}]*+[{ch}]){{3}}[^{ch}]*+\z"), ch).otherwise(sign)
    by_value = F.split(bare(F.replace(text, sign, F.lit(_SEP))), _SEP)
    together = F.coalesce(
        F.when(F.size(named) == 5, F.array_join(F.array_sort(F.slice(named, 2, 4)), _SEP)),
        F.array_join(F.array_sort(by_value), _SEP),
        bare(text),
    )
    return F.when(text.contains(_SEP), _key_by_field(text)).otherwise(together)


def _key_by_field(text: Column) -> Column:
    """``line_key`` of a text that may hold the sign between bare fields: each field is made bare alone."""
    label = "|".join(LABELS)
    fields = F.split(text, rf"(?i)\p{{IsWhite_Space}}*[,;|/\t]\p{{IsWhite_Space}}*(?=(?:{label})\p{{IsWhite_Space}}*[=:])")
    named = F.transform(
        fields,
        lambda f: F.concat(
            F.lower(F.regexp_extract(f, rf"(?i)^({label})\p{{IsWhite_Space}}*[=:]", 1)),
            F.lit("="),
            bare(F.regexp_replace(f, rf"(?i)^(?:{label})\p{{IsWhite_Space}}*[=:]", "")),
        ),
    )
    is_named = text.rlike(rf"(?i)^(?:{label})\p{{IsWhite_Space}}*[=:]") & (F.size(fields) == 4)
    by_value = F.lit(None).cast("array<string>")
    for sign in reversed(SIGNS):
        parts = F.split(text, rf"[{sign}]")
        by_value = F.when(F.size(parts) == 4, F.transform(parts, bare)).otherwise(by_value)
    return F.coalesce(
        F.when(is_named, F.array_join(F.array_sort(named), _SEP)),
        F.array_join(F.array_sort(by_value), _SEP),
        bare(text),
    )


def line_keys(raw_lines: DataFrame) -> DataFrame:
    """(tbl, file, key, id) of the lines that hold anything."""
    lines = raw_lines.filter(F.col("line").isNotNull() & F.col("file").isNotNull())
    # columns of their own, as they are needed several times
    parts = lines.select("file", F.col("line_id").alias("id"), "line", _line_text(F.col("line")).alias("text")).withColumn("named", _named_fields(F.col("text")))
    key = line_key(F.col("text"), F.col("named"))
    # a filter makes the key again, so nearly all lines are known by any sign that is left of them
    return parts.filter(F.col("line").rlike(_ANYTHING) | (key != "")).select(F.lit("raw_lines").alias("tbl"), "file", key.alias("key"), "id")


#: Rows of one range of the sort.
RANGE_ROWS = 250_000
_SCAN = "part int, first string, last string, tbl string, rep bigint, id bigint, head boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in one sorted range: a row for each later member, and for all of the first run.

    Ends with one summary row (id null): the digests of the first and last key and the
    representative of the last run.
    """
    part = TaskContext.get().partitionId()
    schema = pa.schema(
        [("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("tbl", pa.string()), ("rep", pa.int64()), ("id", pa.int64()), ("head", pa.bool_())]
    )
    first = before = rep = tbl = None
    in_head = True
    digest = lambda key: hashlib.sha256("\0".join(key).encode()).hexdigest()
    for block in batches:
        n = block.num_rows
        if not n:
            continue
        columns = [block.column(c) for c in ("tbl", "file", "key")]
        ids = block.column("id").to_numpy()
        start = tuple(c[0].as_py() for c in columns)
        same = None
        for c in columns:
            equal = pc.equal(c.slice(1), c.slice(0, n - 1))
            same = equal if same is None else pc.and_(same, equal)
        starts = np.concatenate(([0], pc.indices_nonzero(pc.invert(same)).to_numpy().astype(np.int64) + 1))
        sizes = np.diff(np.append(starts, n))
        reps = np.repeat(ids[starts], sizes)
        keep, mask = np.ones(n, bool), np.zeros(n, bool)
        keep[starts] = False
        joined = start == before
        if joined:
            reps[: sizes[0]], keep[0] = rep, True
        if first is None:
            first = start
        in_head = in_head and (joined or before is None)
        if in_head:
            mask[: sizes[0]] = True
        in_head = in_head and len(starts) == 1
        out = pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), columns[0].cast(pa.string()), pa.array(reps), pa.array(ids), pa.array(mask)],
            schema=schema,
        ).filter(pa.array(keep | mask))
        if out.num_rows:
            yield out
        before = tuple(c[n - 1].as_py() for c in columns)
        rep, tbl = int(reps[-1]), before[0]
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip((part, digest(first), digest(before), tbl, rep, None, False), schema, strict=True)], schema=schema
        )


def sorted_rows(keyed: DataFrame, ranges: int) -> DataFrame:
    """(tbl, file, key, id) range-partitioned and sorted by a number of the full key, the key and the id.

    A number sorts faster than texts; full keys are compared where it is equal. It is made again after
    the exchange, as it can't be compressed on the way.
    """
    columns = ["tbl", "file", "key", "id"]
    digest = F.xxhash64("tbl", "file", "key")
    return keyed.select(*columns).repartitionByRange(ranges, digest, *columns).withColumn("digest", digest).sortWithinPartitions("digest", *columns).select(*columns)


def copies(keyed: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    """(tbl, key_a, key_b): the smallest id of each set of equal (tbl, file, key) with each other id.

    ``left_out``: rows with one of these (lang, word) are no copies of anything.
    """
    spark = keyed.sparkSession
    columns = ["tbl", "file", "key", "id"]
    # the keys are needed for their number, for the bounds of the ranges and for the sort
    made = keyed.select(*columns, *(() if left_out is None else ("lang", "word"))).persist(StorageLevel.MEMORY_AND_DISK)
    # an explicit number of ranges is not split later, so it grows with the rows
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made.count() // RANGE_ROWS))
    keyed = made
    if left_out is not None:
        kept = stored(made.filter("word is not null").join(left_out, ["lang", "word"], "left_anti").select(*columns))
        keyed = made.filter("word is null").select(*columns).unionByName(kept)
    scanned = checkpointed(sorted_rows(keyed, ranges).mapInArrow(_scan, _SCAN))
    made.unpersist()
    carried, last, rep = [], None, None
    for row in scanned.filter("id is null").select("part", "first", "last", "rep").orderBy("part").collect():  # one per range
        joins = row["first"] == last
        carry = rep if joins else None
        carried.append((row["part"], carry))
        rep = carry if joins and row["first"] == row["last"] else row["rep"]
        last = row["last"]
    carry = spark.createDataFrame(carried, "part int, carry bigint")
    rows = scanned.filter("id is not null").join(F.broadcast(carry), "part")
    rep = F.when(F.col("head"), F.coalesce("carry", "rep")).otherwise(F.col("rep"))
    return rows.select("tbl", rep.alias("key_a"), F.col("id").alias("key_b")).filter("key_a <> key_b")


def format_copies(raw_freq: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """(tbl, key_a, key_b) of the rows of both tables that repeat in other formatting."""
    keyed, left_out = word_keys(raw_freq)
    return copies(keyed.unionByName(line_keys(raw_lines), allowMissingColumns=True), left_out)


def copy_counts(raw_freq: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """(tbl, key_a, copies): the representative of each set of two or more and the size of the set."""
    return format_copies(raw_freq, raw_lines).groupBy("tbl", "key_a").agg((F.count(F.lit(1)) + 1).alias("copies"))
