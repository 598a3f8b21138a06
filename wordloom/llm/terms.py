"""Problem 5: how often every term occurs, in how many records, and which are too rare or too common.

Method: the lines of each task are a block. A block's terms are encoded and two arrays accumulated,
occurrences and records that hold the term. A global integer dictionary over (language, term) is split
by identifier range: a task owns the terms hashed to it, sorts them outside memory if need be, and a
term's identifier is its place in the range; the arrays of all blocks are summed by identifier. One
shuffle brings a file's terms together (distinct lines, record presence), one brings the blocks'
arrays to the ranges.

Edge cases: null words, files, frequencies or frequencies below 1 are not counted; a term without a
letter is dropped; lines delivered again count once; versions of a line that differ in word or
frequency count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All that may stand before the first or after the last letter, mark or digit of a term.
_EDGES = r"\A[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+\z"


def term_of(word: Column) -> Column:
    """The word between its first and last letter, mark or digit, in lower case."""
    # most words are bare already and skip the replacement
    # (\z, not $: the latter also stands before a final line separator)
    bare = F.when(word.rlike(r"(?s)\A[\p{L}\p{M}\p{N}].*[\p{L}\p{M}\p{N}]\z"), word).otherwise(F.regexp_replace(word, _EDGES, ""))
    return F.lower(bare)


def counted_lines(raw_freq: DataFrame) -> DataFrame:
    """The lines that count: with a letter in the word and a frequency of 1 or more."""
    return raw_freq.filter(F.col("file").isNotNull() & (F.col("frequency") >= 1) & F.col("word").rlike(r"\p{L}"))


def file_terms(raw_freq: DataFrame) -> DataFrame:
    """(lang, file, term, total): frequencies of the distinct lines of each file by term."""
    lines = counted_lines(raw_freq).select("file", "ord", term_of(F.col("word")).alias("term"), "frequency")
    return (
        # hashed on (file, term): the rows of one line stay together, a large file is spread
        lines.repartition("file", "term")
        .dropDuplicates(["file", "ord", "term", "frequency"])
        .groupBy("file", "term")
        .agg(F.sum("frequency").alias("total"))
        .select(F.substring("file", 1, 3).alias("lang"), "file", "term", "total")
    )


#: Terms of a block; a task that meets more of them starts another block.
BLOCK_TERMS = 500_000


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encodes a block's terms and accumulates its count arrays: a row for each term, with its occurrences and records."""
    held: list[pa.Table] = []
    size = 0

    def counted() -> pa.RecordBatch:
        block = pa.concat_tables(held).combine_chunks()
        lang, term = (block.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term"))
        pair = lang.indices.to_numpy().astype(np.int64) * len(term.dictionary) + term.indices.to_numpy()
        seen, code = np.unique(pair, return_inverse=True)
        totals, records = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64)
        np.add.at(totals, code, block.column("total").to_numpy())
        np.add.at(records, code, block.column("files").to_numpy())
        at_lang, at_term = np.divmod(seen, len(term.dictionary))
        columns = [lang.dictionary.take(pa.array(at_lang)), term.dictionary.take(pa.array(at_term)), pa.array(totals), pa.array(records)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "total", "files"])

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
        if size >= BLOCK_TERMS:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def _range_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The dictionary entries of one identifier range and the sums of the blocks' arrays over it.

    The rows come sorted by language and term, so that a term's identifier is its place; the last
    term of a batch waits for the next one.
    """
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("code", pa.int64()), ("total", pa.int64()), ("files", pa.int64())])
    code, last = 0, None

    def entry(found: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(found, schema, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        lang, term = batch.column("lang"), batch.column("term")
        same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.equal(term.slice(1), term.slice(0, len(term) - 1)))
        starts = np.concatenate(([0], pc.indices_nonzero(pc.invert(same)).to_numpy().astype(np.int64) + 1))
        totals = np.add.reduceat(batch.column("total").to_numpy(), starts)
        records = np.add.reduceat(batch.column("files").to_numpy(), starts)
        if last is not None and last[:2] == (lang[0].as_py(), term[0].as_py()):
            totals[0] += last[3]
            records[0] += last[4]
        elif last is not None:
            yield entry(last)
            code += 1
        n = len(starts) - 1
        if n:
            at = pa.array(starts[:-1])
            yield pa.RecordBatch.from_arrays([lang.take(at).cast(pa.string()), term.take(at).cast(pa.string()), pa.array(np.arange(code, code + n)), pa.array(totals[:-1]), pa.array(records[:-1])], schema=schema)
        code += n
        end = int(starts[-1])
        last = (lang[end].as_py(), term[end].as_py(), code, int(totals[-1]), int(records[-1]))
    if last is not None:
        yield entry(last)


def term_counts(per_file: DataFrame) -> DataFrame:
    """(lang, term, term_id, total, files) of every term; term_id is unique over the whole collection."""
    rows = per_file.select("lang", "term", "total", F.lit(1).cast("bigint").alias("files"))
    blocks = rows.mapInArrow(_block_counts, "lang string, term string, total bigint, files bigint")
    ranges = blocks.repartition("lang", "term").sortWithinPartitions("lang", "term")
    counted = ranges.mapInArrow(_range_sums, "lang string, term string, code bigint, total bigint, files bigint")
    # the identifier range of a task starts at its number times 2^33
    term_id = F.shiftleft(F.spark_partition_id().cast("bigint"), 33) + F.col("code")
    return counted.select("lang", "term", term_id.alias("term_id"), "total", "files")


def marked_terms(raw_freq: DataFrame, rare_total: int = 2, common_pct: int = 60) -> DataFrame:
    """(lang, term, total, files, mark): 'rare', 'common' or null.

    rare: in one file and at most ``rare_total`` occurrences; common: in two files or more and in at
    least ``common_pct`` per cent of the language's files that have a counted term.
    """
    per_file = file_terms(raw_freq)
    # straight from the scan: its own narrow pass is cheaper than a second shuffle of the lines
    files = counted_lines(raw_freq).select(F.substring("file", 1, 3).alias("lang"), "file").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("lang_files"))
    mark = F.when((F.col("files") == 1) & (F.col("total") <= rare_total), "rare").when(
        (F.col("files") >= 2) & (F.col("files") * 100 >= F.col("lang_files") * common_pct), "common"
    )
    return (
        term_counts(per_file).join(files, "lang").select("lang", "term", "total", "files", mark.alias("mark"))
    )
