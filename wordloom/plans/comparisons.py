"""Registered queries that compare languages, files and results; their SQL is in ``comparisons_sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import filters, frequency, report, statistics
from wordloom.operators.frequency import rounded
from wordloom.plans.queries import QUERIES as CORE
from wordloom.plans.queries import _coverage_points, _language_values, _latest_quality, _lines, _round, _segmented, _words
from wordloom.sources.tables import table

QUERIES = {}

#: Kinds of sources by a mark in the file name.
SOURCE_GROUPS = {"press": ("news", "radio", "letters"), "reference": ("wiki", "law", "school"), "web": ("web", "forum")}


def query(build):
    QUERIES[build.__name__] = build
    return build


def _kind() -> F.Column:
    return F.split_part("file", F.lit("_"), F.lit(2))


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_freq").filter("file is not null").select("file").distinct()


# ---------------------------------------------------------------- cuts and orders


@query
def w9_tie_band(s: SparkSession, d: str) -> DataFrame:
    """The frequency at which 94 per cent are covered, how many words have it and how many of them are kept."""
    return frequency.cut_band(_words(s, d)).select("lang", "last", "needed", "tied")


@query
def a36_cut_share(s: SparkSession, d: str) -> DataFrame:
    """Share of words kept at 94 per cent of coverage."""
    long = frequency.coverage(_words(s, d), (94.0, 100.0))
    kept = lambda level: F.max(F.when(F.col("level") == level, F.col("types")))
    return long.groupBy("lang").agg(kept(94.0).alias("kept"), rounded(kept(94.0) * 100.0 / kept(100.0), 4).alias("kept_pct"))


@query
def w14_interpolated(s: SparkSession, d: str) -> DataFrame:
    """Tokens down to an eighth and a third of the words, between ranks interpolated."""
    return _round(frequency.tokens_at(_words(s, d), 0.125, 1 / 3), places=3)


@query
def w5_new_words(s: SparkSession, d: str) -> DataFrame:
    """Words of a language known after each of its files, in the order of their names."""
    order = Window.partitionBy("lang").orderBy("file").rowsBetween(Window.unboundedPreceding, 0)
    return frequency.merge_report(_lines(s, d)).select("lang", "file", "new_types", F.sum("new_types").over(order).alias("known"))


@query
def a39_longest_list(s: SparkSession, d: str) -> DataFrame:
    """The file of each language with the most words; equal ones by name."""
    sizes = frequency.cleaned(_lines(s, d)).groupBy("lang", "file").agg(F.count_distinct("word").alias("types"))
    best = sizes.groupBy("lang").agg(F.min(F.struct((-F.col("types")).alias("m"), "file")).alias("b"))
    return best.select("lang", "b.file", (-F.col("b.m")).alias("types"))


@query
def a40_merged_kinds(s: SparkSession, d: str) -> DataFrame:
    """Files of one kind merged: words and tokens of each language and kind."""
    words = frequency.cleaned(_lines(s, d)).groupBy("lang", _kind().alias("kind"), "word").agg(F.sum("frequency").alias("f"))
    return words.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("types"), F.sum("f").alias("tokens"))


@query
def a65_key_values(s: SparkSession, d: str) -> DataFrame:
    """Probability of each word of a language and its mean frequency over lines."""
    keyed = frequency.cleaned(_lines(s, d)).groupBy("lang", "word").agg(F.sum("frequency").alias("f"), F.count(F.lit(1)).alias("c"))
    total = keyed.groupBy("lang").agg(F.sum("f").alias("total"))
    both = keyed.join(total, "lang")
    return both.select("lang", "word", rounded(F.col("f") / F.col("total"), 9).alias("probability"), rounded(F.col("f") / F.col("c"), 6).alias("mean"))


@query
def a66_sample_characters(s: SparkSession, d: str) -> DataFrame:
    """How many different characters the sampled lines of a language have."""
    signs = filters.sampled_lines(_lines(s, d)).select("lang", F.explode(F.array_distinct(F.split("word", ""))).alias("ch"))
    return signs.filter("ch <> ''").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("characters"))


@query
def a41_most_shared(s: SparkSession, d: str) -> DataFrame:
    """The largest share of its hapaxes that a file has in common with another."""
    pairs = filters.hapax_overlap(_lines(s, d))
    sides = [pairs.select(F.col(f"file_{x}").alias("file"), F.col(f"share_{x}_pct").alias("share")) for x in "ab"]
    return frequency.bag_union(*sides).groupBy("file").agg(F.max("share").alias("most"))


@query
def j21_pairs_kept(s: SparkSession, d: str) -> DataFrame:
    """Pairs of files of which neither is left out."""
    rows = _lines(s, d)
    pairs = filters.hapax_overlap(rows)
    gone = filters.overlap_ignored(filters.top_pairs(filters.overlap_above(rows, 6.0)), 6.0).select("file")
    for side in ("file_a", "file_b"):
        pairs = pairs.join(gone.withColumnRenamed("file", side), side, "left_anti")
    return pairs.select("file_a", "file_b", "overlap")


# ---------------------------------------------------------------- statistics


@query
def a44_whiskers(s: SparkSession, d: str) -> DataFrame:
    return _round(statistics.whiskers(_latest_quality(s, d).filter("program_pct is not null"), "program_pct", "lang"), places=9)


@query
def a47_usual_script(s: SparkSession, d: str) -> DataFrame:
    """Files by script of each language; the most usual script is marked."""
    counts = _latest_quality(s, d).filter("script is not null").groupBy("lang", "script").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "script"))
    return counts.withColumn("usual", place == 1)


@query
def a50_quality_score(s: SparkSession, d: str) -> DataFrame:
    """Sum of four shares of each language, each divided by its largest."""
    names = ("foreign_script_pct", "long_outlier_pct", "punct_char_pct", "program_pct")
    means = _latest_quality(s, d).groupBy("lang").agg(*(F.avg(n).alias(n) for n in names))
    whole = Window.partitionBy(F.lit(0))  # one row per three-letter code
    score = sum((F.coalesce(F.try_divide(F.col(n), F.max(n).over(whole)), F.lit(0.0)) for n in names), F.lit(0.0))
    return means.select("lang", rounded(score, 8).alias("score"))


@query
def a51_causes(s: SparkSession, d: str) -> DataFrame:
    """The share of damaged rows of a file, split by cause in proportion to the causes' own shares."""
    causes = {"foreign": "foreign_script_pct", "long": "long_outlier_pct", "program": "program_pct"}
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in causes.values()), F.lit(0.0))
    whole = F.when(total == 0, 1.0).otherwise(total)
    return _latest_quality(s, d).select("file", *(rounded(F.coalesce(F.col(c), F.lit(0.0)) / whole * F.col("corrupted_pct"), 9).alias(n) for n, c in causes.items()))


@query
def a54_group_score(s: SparkSession, d: str) -> DataFrame:
    """Mean of the scores of the grouping by family and by genus."""
    values = _language_values(s, d)
    scores = frequency.bag_union(*(statistics.clustering(values, "value", g).select("score") for g in ("family", "genus")))
    return scores.agg(rounded(F.avg("score"), 5).alias("score"), F.count("score").alias("groupings"))


@query
def a55_family_means(s: SparkSession, d: str) -> DataFrame:
    return _language_values(s, d).filter("family is not null").groupBy("family").agg(
        F.min("genus").alias("genus"), rounded(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("languages")
    )


@query
def a60_break_test(s: SparkSession, d: str) -> DataFrame:
    """Whether coverage has a break: error of one and of two lines, F and its probability."""
    tested = statistics.break_test(_coverage_points(s, d), "lang")
    return tested.select("lang", "x", "n", rounded("rss", 2).alias("rss"), rounded("f", 2).alias("f"), (F.col("p") < 0.001).alias("broken"))


@query
def a69_extremes(s: SparkSession, d: str) -> DataFrame:
    """The files of each language with the least and the greatest share of damaged rows; equal ones by name."""
    rows = _latest_quality(s, d).filter("corrupted_pct is not null")
    least = F.min(F.struct("corrupted_pct", "file")).alias("a")
    most = F.min(F.struct((-F.col("corrupted_pct")).alias("m"), "file")).alias("b")
    return rows.groupBy("lang").agg(least, most).select("lang", F.col("a.file").alias("least"), F.col("b.file").alias("most"))


# ---------------------------------------------------------------- projections, joins, presentation


@query
def r6_several_files(s: SparkSession, d: str) -> DataFrame:
    """Files of languages that have two or more."""
    n = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    return _files(s, d).withColumn("lang", F.substring("file", 1, 3)).withColumn("files", n).filter("files >= 2")


#: Families whose languages are labelled by genus, with the mark of the family.
MARKED_FAMILIES = {"Indo-European": "(IE)", "Altaic": "(Alt)"}


@query
def r14_labels(s: SparkSession, d: str) -> DataFrame:
    """Family as a label (of large families the genus), typology shortened, name with the segmentor where there are two."""
    label = F.coalesce("family", F.lit(""))
    for family, mark in MARKED_FAMILIES.items():
        with_genus = F.when(F.col("genus") != "", F.concat("genus", F.lit(f" {mark}"))).otherwise(mark)
        label = F.when(F.col("family") == family, with_genus).otherwise(label)
    name = F.concat(F.coalesce("name", "iso_code"), F.when(F.col("iso_code").isin("deu", "rus"), F.lit(" (Morfo)")).otherwise(F.lit("")))
    short = F.coalesce(F.substring("typology", 1, 3), F.lit(""))
    return table(s, d, "languages").select("iso_code", label.alias("label"), short.alias("short"), name.alias("shown"))


@query
def k13_thousands(s: SparkSession, d: str) -> DataFrame:
    """Words of each language in thousands, as a table shows them."""
    return _words(s, d).groupBy("lang").agg(F.format_string("%.1f", F.count(F.lit(1)) / 1000).alias("types"))


@query
def w8_renumbered(s: SparkSession, d: str) -> DataFrame:
    """Languages renumbered by the mean and the best of their places in four rankings."""
    names = ("foreign_script_pct", "long_outlier_pct", "punct_char_pct", "program_pct")
    means = _latest_quality(s, d).groupBy("lang").agg(*(rounded(F.avg(n), 8).alias(n) for n in names))
    whole = Window.partitionBy(F.lit(0))  # one row per three-letter code
    placed = means.select("lang", *(F.row_number().over(whole.orderBy(n, "lang")).alias(n) for n in names))
    places = placed.select("lang", F.explode(F.array(*names)).alias("pos"))
    per = places.groupBy("lang").agg(F.avg("pos").alias("mean_place"), F.min("pos").alias("best_place"))
    return per.withColumn("place", F.row_number().over(whole.orderBy("mean_place", "best_place", "lang")))


MEASURES = ("foreign_script_pct", "long_outlier_pct", "punct_char_pct", "program_pct", "corrupted_pct", "total_types")


@query
def a56_matrix(s: SparkSession, d: str) -> DataFrame:
    """Correlation of every two measures of the files, in one pass."""
    return _round(statistics.correlations(_latest_quality(s, d), MEASURES), "pearson")


@query
def r20_script_groups(s: SparkSession, d: str) -> DataFrame:
    """Checked files by group of scripts."""
    group = F.lit("Other")
    for name, codes in T.SCRIPT_GROUPS.items():
        group = F.when(F.col("script").isin(*codes), name).otherwise(group)
    return _latest_quality(s, d).filter("script is not null").groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("files"))


@query
def x41_sizes(s: SparkSession, d: str) -> DataFrame:
    """Logarithms of the tokens of each language, at least one, stretched to 5 to 400."""
    tokens = _lines(s, d).groupBy("lang").agg(F.log10(F.greatest(F.sum("frequency"), F.lit(1)).cast("double")).alias("v"))
    return statistics.stretched(tokens, "v", 5.0, 400.0).select("lang", rounded("stretched", 4).alias("size"))


@query
def r19_source_groups(s: SparkSession, d: str) -> DataFrame:
    """Tokens and files by group of sources, told by marks in the file name."""
    group = F.lit("other")
    for name, marks in SOURCE_GROUPS.items():
        group = F.when(_kind().isin(*marks), name).otherwise(group)
    per = _lines(s, d).groupBy("file").agg(F.sum("frequency").alias("tokens"))
    return per.groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"))


@query
def r23_log_points(s: SparkSession, d: str) -> DataFrame:
    """Sizes of files on logarithmic scales; zeros are left out first."""
    return _latest_quality(s, d).filter("total_types > 0 and total_frequency > 0").select(
        "file", rounded(F.log10("total_types"), 9).alias("x"), rounded(F.log10("total_frequency"), 9).alias("y")
    )


@query
def j10_named_totals(s: SparkSession, d: str) -> DataFrame:
    """Totals with the language's name, or its code where the list lacks it."""
    names = table(s, d, "languages").select(F.col("iso_code").alias("lang"), "name", "family")
    joined = report.left_joined(frequency.totals(_words(s, d)).select("lang", "types", "tokens"), names, on="lang")
    return joined.withColumn("name", F.coalesce(report.first_filled("name"), "lang"))


@query
def j14_inner_results(s: SparkSession, d: str) -> DataFrame:
    """Languages that have lists, checks and morphs."""
    checks = _latest_quality(s, d).groupBy("lang").agg(rounded(F.avg("punct_char_pct"), 8).alias("punct"))
    segmented = _segmented(s, d).groupBy(F.substring("file", 1, 3).alias("lang")).agg(F.count_distinct("word").alias("segmented"))
    return report.inner_chain(frequency.totals(_words(s, d)).select("lang", "types"), checks, segmented, on="lang")


@query
def j22_script_names(s: SparkSession, d: str) -> DataFrame:
    """Script codes of checked files by name; unknown codes stay."""
    names = F.create_map(*(F.lit(x) for pair in T.SCRIPT_CODES.items() for x in pair))
    return _latest_quality(s, d).select("file", F.coalesce(names[F.col("script")], "script").alias("script"))


@query
def k4_script_table(s: SparkSession, d: str) -> DataFrame:
    """Share of each script in the sampled letters of a language, one column per script and one for all others."""
    letters = filters.script_letters(filters.sampled_lines(_lines(s, d)))
    names = [*T.SCRIPTS, "Other"]
    wide = letters.groupBy("lang").pivot("script", names).agg(F.sum("letters")).na.fill(0)
    total = sum((F.col(n) for n in names), F.lit(0))
    return wide.select("lang", *(rounded(F.col(n) * 100.0 / total, 4).alias(n.lower()) for n in names))


@query
def k19_output_names(s: SparkSession, d: str) -> DataFrame:
    """Names of written lists: language and kind, with year and number where there are several."""
    parts = _files(s, d).withColumns({"lang": F.substring("file", 1, 3), "kind": _kind()})
    stem = F.regexp_replace("file", r"\.csv$", "")
    rest = F.concat_ws("-", F.split_part(stem, F.lit("_"), F.lit(3)), F.split_part(stem, F.lit("_"), F.lit(4)))
    n = F.count(F.lit(1)).over(Window.partitionBy("lang", "kind"))
    base = F.concat_ws("-", "lang", "kind")
    return parts.select("file", F.concat(F.when(n == 1, base).otherwise(F.concat_ws("-", base, rest)), F.lit(".csv")).alias("name"))


@query
def x18_file_parts(s: SparkSession, d: str) -> DataFrame:
    """Language, kind, year and number from file names; null where a part is no number."""
    part = lambda group: F.regexp_extract("file", r"^(.{3})_([^_]+)_(\d+)_(\d+)\.csv$", group)
    number = lambda group: F.nullif(part(group), F.lit("")).cast("bigint")
    return _files(s, d).select("file", part(1).alias("lang"), part(2).alias("kind"), number(3).alias("year"), number(4).alias("number"))


@query
def x44_numbers_in_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of each file whose second field is a number, whatever separates the fields, and the sum of these numbers."""
    field = F.trim(F.split_part(F.regexp_replace("line", r"[|;,\t]", "|"), F.lit("|"), F.lit(2)))
    rows = table(s, d, "raw_lines").filter("line is not null and file is not null").select("file", F.when(field.rlike("^[0-9]+$"), field).try_cast("bigint").alias("v"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count("v").alias("numbers"), F.coalesce(F.sum("v"), F.lit(0)).alias("total"))


@query
def x45_endings(s: SparkSession, d: str) -> DataFrame:
    """Words of each language by their last two letters."""
    return _words(s, d).groupBy("lang", F.right("word", F.lit(2)).alias("ending")).agg(F.count(F.lit(1)).alias("words"), F.sum("frequency").alias("tokens"))


assert not set(QUERIES) & set(CORE)
