"""Which files to leave out: hapax overlap, scripts, ignore lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import script_of
from wordloom.operators.frequency import hapax_words
from wordloom.session import checkpointed

MAX_PAIRS = 16
OVERLAP_PCT = 33.3
SCRIPT_PCT = 75.0


def _pct(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0)), 2)


def hapax_overlap(rows: DataFrame) -> DataFrame:
    """(lang, file_a, file_b, hapaxes_a, hapaxes_b, overlap, share_a_pct, share_b_pct) of files of a language.

    Pairs come from the words that two files share (an inverted index), so pairs without a common
    hapax are not made; their overlap is 0.
    """
    hapaxes = hapax_words(rows)
    a = hapaxes.withColumnRenamed("file", "file_a")
    b = hapaxes.withColumnRenamed("file", "file_b")
    common = a.join(b, ["lang", "word"]).filter("file_a < file_b").groupBy("lang", "file_a", "file_b").agg(F.count(F.lit(1)).alias("overlap"))
    return _with_shares(common, _sizes(hapaxes))


def _sizes(hapaxes: DataFrame) -> DataFrame:
    return hapaxes.groupBy("file").agg(F.count(F.lit(1)).alias("hapaxes"))


def _with_shares(common: DataFrame, sizes: DataFrame) -> DataFrame:
    size = lambda side: sizes.select(F.col("file").alias(f"file_{side}"), F.col("hapaxes").alias(f"hapaxes_{side}"))
    return (
        common.join(size("a"), "file_a")
        .join(size("b"), "file_b")
        .withColumn("share_a_pct", _pct(F.col("overlap"), F.col("hapaxes_a")))
        .withColumn("share_b_pct", _pct(F.col("overlap"), F.col("hapaxes_b")))
    )


def overlap_above(rows: DataFrame, threshold: float = OVERLAP_PCT) -> DataFrame:
    """The pairs of ``hapax_overlap`` of which one file shares more than ``threshold`` per cent.

    Such a file shares one of its rarest hapaxes with the other: of n hapaxes of which m must be shared
    the n - m + 1 that the fewest files hold. Only these are paired; the others, among them words that
    very many files hold, are counted for pairs found so.
    """
    hapaxes = checkpointed(hapax_words(rows))
    held = hapaxes.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("files"))
    sizes = _sizes(hapaxes)
    # shares are rounded to two places
    needed = F.greatest(F.lit(1), F.ceil(F.col("hapaxes") * ((threshold - 0.005) / 100)))
    place = F.row_number().over(Window.partitionBy("file").orderBy("files", "word"))
    marked = hapaxes.join(held, ["lang", "word"]).join(sizes, "file").withColumn("rare", place <= F.col("hapaxes") - needed + 1)
    marked = checkpointed(marked.select("lang", F.col("file").alias("file_a"), "word", "files", "rare"))
    other = hapaxes.withColumnRenamed("file", "file_b")
    rare = marked.filter(F.col("rare") & (F.col("files") > 1)).join(other, ["lang", "word"]).filter("file_a <> file_b")
    found = checkpointed(rare.groupBy("lang", "file_a", "file_b").agg(F.count(F.lit(1)).alias("n")))
    rest = found.select("file_a", "file_b").join(marked.filter(~F.col("rare")), "file_a").join(other, ["lang", "file_b", "word"], "left_semi")
    total = found.unionByName(rest.groupBy("lang", "file_a", "file_b").agg(F.count(F.lit(1)).alias("n")))
    overlap = total.groupBy("lang", "file_a", "file_b").agg(F.sum("n").alias("overlap"))
    # found from one file or from both, a pair has the same overlap
    once = overlap.select("lang", F.least("file_a", "file_b").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b"), "overlap").distinct()
    return _with_shares(once, sizes).filter(F.greatest("share_a_pct", "share_b_pct") > threshold)


def top_pairs(pairs: DataFrame, most: int = MAX_PAIRS) -> DataFrame:
    """The pairs of each language with the largest share, with their place; equal ones by file names."""
    order = Window.partitionBy("lang").orderBy(F.greatest("share_a_pct", "share_b_pct").desc(), "file_a", "file_b")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def overlap_ignored(pairs: DataFrame, threshold: float = OVERLAP_PCT) -> DataFrame:
    """(lang, file, reason): one file of each pair above the threshold, in the pairs' order.

    A pair is skipped if either of its files is left out already, so the choice depends on the order:
    a fold over the at most ``MAX_PAIRS`` pairs of a language.
    """
    a_goes = F.col("share_a_pct") >= F.col("share_b_pct")
    step = F.struct(
        "place",
        F.when(a_goes, F.col("file_a")).otherwise(F.col("file_b")).alias("victim"),
        F.when(a_goes, F.col("file_b")).otherwise(F.col("file_a")).alias("other"),
        F.greatest("share_a_pct", "share_b_pct").alias("pct"),
    )
    listed = pairs.filter(F.greatest("share_a_pct", "share_b_pct") > threshold).groupBy("lang").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    start = F.array().cast("array<struct<file:string,reason:string>>")
    gone = lambda acc, file: F.exists(acc, lambda x: x["file"] == file)
    added = lambda s: F.array(F.struct(s["victim"].alias("file"), F.concat(_pct_text(s["pct"]), F.lit(" hapax overlap with "), s["other"]).alias("reason")))
    folded = F.aggregate("steps", start, lambda acc, s: F.when(gone(acc, s["victim"]) | gone(acc, s["other"]), acc).otherwise(F.concat(acc, added(s))))
    return listed.select("lang", F.explode(folded).alias("x")).select("lang", "x.file", "x.reason")


def sampled_lines(rows: DataFrame, step: int = 5, most: int = 10_000) -> DataFrame:
    """Every ``step``-th line of a file by its place, and at most ``most`` of them (a sampling operator)."""
    return rows.filter((F.col("ord") % step == 0) & (F.col("ord") < step * most))


def script_letters(rows: DataFrame) -> DataFrame:
    """(lang, file, script, letters, first_ord): every third letter of sampled words by script."""
    letters = F.filter(F.split("word", ""), lambda ch: ch.rlike(r"\p{L}"))
    third = F.filter(letters, lambda ch, i: i % 3 == 0)
    # letters are counted before they are told apart by script: few distinct ones are left
    counted = rows.select("lang", "file", "ord", F.explode(third).alias("ch")).groupBy("lang", "file", "ch").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    return counted.groupBy("lang", "file", script_of(F.col("ch")).alias("script")).agg(F.sum("n").alias("letters"), F.min("first_ord").alias("first_ord"))


def file_scripts(counts: DataFrame) -> DataFrame:
    """(lang, file, script, letters, total_letters, pct, place) by falling share; equal ones by first place, then name."""
    order = Window.partitionBy("lang", "file").orderBy(F.col("letters").desc(), "first_ord", "script")
    return (
        counts.withColumn("total_letters", F.sum("letters").over(Window.partitionBy("lang", "file")))
        .withColumn("pct", _pct(F.col("letters"), F.col("total_letters")))
        .withColumn("place", F.row_number().over(order))
    )


def language_scripts(shares: DataFrame, most: int = 2) -> DataFrame:
    """(lang, script, share_pct, place): a language's scripts, files weighted by letters times rounded per cent."""
    weight = F.sum(F.col("total_letters") * F.col("pct") / 100)
    per = shares.groupBy("lang", "script").agg(weight.alias("weight"))
    order = Window.partitionBy("lang").orderBy(F.col("weight").desc(), "script")
    return (
        per.withColumn("share_pct", F.round(F.col("weight") * 100 / F.sum("weight").over(Window.partitionBy("lang")), 2))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= most)
        .select("lang", "script", "share_pct", "place")
    )


def _pct_text(pct: Column) -> Column:
    """One decimal, halves to the even digit."""
    return F.concat(F.format_number(pct, 1), F.lit("%"))


def script_ignored(shares: DataFrame, threshold: float = SCRIPT_PCT) -> DataFrame:
    """(lang, file, reason): files in which the language's main script has less than the threshold."""
    main = language_scripts(shares, 1).select("lang", F.col("script").alias("main"))
    of_file = F.max(F.when(F.col("place") == 1, F.struct("script", "pct"))).alias("own")
    of_main = shares.join(main, "lang").groupBy("lang", "file", "main").agg(F.sum(F.when(F.col("script") == F.col("main"), F.col("pct")).otherwise(0.0)).alias("pct"), of_file)
    need = F.lit(f"(need >= {threshold:.1f}%)")
    same = F.concat(F.lit("lang script "), "main", F.lit(" only "), _pct_text(F.col("pct")), F.lit(" in file "), need)
    other = F.concat(
        F.lit("file is "), _pct_text(F.col("own.pct")), F.lit(" "), F.col("own.script"), F.lit(", but lang script is "), "main", F.lit(" (only "), _pct_text(F.col("pct")), F.lit(f" in file, need >= {threshold:.1f}%)")
    )
    return of_main.filter(F.col("pct") < threshold).select("lang", "file", F.when(F.col("own.script") == F.col("main"), same).otherwise(other).alias("reason"))


def manual_ignored(files: DataFrame) -> DataFrame:
    """(lang, file, reason) of a list of file names made by hand, the first of the lists to be united."""
    return files.select(F.substring("file", 1, 3).alias("lang"), "file", F.lit("manual ignore").alias("reason"))


def priority_union(*lists: DataFrame) -> DataFrame:
    """(lang, file, reason) of several lists; of equal files the first list's row stays."""
    ordered = [frame.select("lang", "file", "reason", F.lit(i).alias("priority")) for i, frame in enumerate(lists)]
    rows = ordered[0]
    for frame in ordered[1:]:
        rows = rows.unionByName(frame)
    order = Window.partitionBy("file").orderBy("priority", "reason")
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").select("lang", "file", "reason")


def without_ignored(rows: DataFrame, ignored: DataFrame) -> DataFrame:
    """Rows of files that are not on the list."""
    return rows.join(ignored.select("file").distinct(), "file", "left_anti")
