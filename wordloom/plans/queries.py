"""Registered queries over the given tables, one per operator or small group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import compress, filters, frequency, metrics, morphs, quality, report, segment, statistics
from wordloom.operators.frequency import rounded
from wordloom.session import ship_package
from wordloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _lines(s: SparkSession, d: str) -> DataFrame:
    return frequency.lines(table(s, d, "raw_freq"))


def _words(s: SparkSession, d: str) -> DataFrame:
    return frequency.merged(_lines(s, d))


def _segmented(s: SparkSession, d: str) -> DataFrame:
    return morphs.parsed(table(s, d, "segmented"))


def _latest_quality(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "quality").filter(F.col("file").isNotNull())
    return report.latest(rows, "file", "checked_at").withColumn("lang", F.substring("file", 1, 3))


def _round(frame: DataFrame, *names: str, places: int = 6) -> DataFrame:
    doubles = names or [f.name for f in frame.schema.fields if f.dataType.typeName() == "double"]
    return frame.withColumns({n: rounded(n, places) for n in doubles})


# ---------------------------------------------------------------- scans and words


@query
def s1_lists(s: SparkSession, d: str) -> DataFrame:
    """Lines, words and tokens of each file; words listed twice are added up."""
    per = _lines(s, d).groupBy("file", "word").agg(F.count(F.lit(1)).alias("n"), F.sum("frequency").alias("f"))
    return per.groupBy("file").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("types"), F.sum("f").alias("tokens"))


@query
def s10_sampled(s: SparkSession, d: str) -> DataFrame:
    """Words of every fifth line."""
    return filters.sampled_lines(_lines(s, d)).groupBy("file").agg(F.count(F.lit(1)).alias("sampled"), F.sum(F.length("word")).cast("bigint").alias("characters"))


@query
def s21_text_words(s: SparkSession, d: str) -> DataFrame:
    """Word counts of texts by language."""
    return frequency.text_words(table(s, d, "documents").filter(F.col("lang").isNotNull()))


@query
def x11_text_words(s: SparkSession, d: str) -> DataFrame:
    """Word counts of texts by language, with the signs that are taken off words of running text."""
    words = table(s, d, "documents").filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", F.explode(F.split("text", r"\s+")).alias("word"))
    cleaned = words.withColumn("word", T.clean_text_word(F.col("word"))).filter(F.col("word").isNotNull())
    return cleaned.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("frequency"))


@query
def s28_characters(s: SparkSession, d: str) -> DataFrame:
    return compress.characters(_words(s, d))


@query
def x1_clean_words(s: SparkSession, d: str) -> DataFrame:
    """Distinct words with their clean form."""
    words = _lines(s, d).select("word").distinct()
    return words.select("word", T.clean_word(F.col("word")).alias("clean"), T.has_letter(F.col("word")).alias("has_letter"))


@query
def x8_word_signs(s: SparkSession, d: str) -> DataFrame:
    """Length, punctuation and web leftovers of distinct words."""
    words = _lines(s, d).select("word").distinct()
    return words.select("word", F.length("word").alias("size"), T.punct_signs(F.col("word")).alias("puncts"), T.is_program(F.col("word")).alias("program"))


@query
def x6_dominant_script(s: SparkSession, d: str) -> DataFrame:
    words = _lines(s, d).select("lang", "word").distinct()
    return words.groupBy("lang", T.dominant_script(F.col("word")).alias("script")).agg(F.count(F.lit(1)).alias("words"))


@query
def x12_morph_roles(s: SparkSession, d: str) -> DataFrame:
    rows = _segmented(s, d).select("file", "word", "annotation").distinct()
    return rows.select("file", "word", F.array_join("annotation", "+").alias("labels"), F.array_join(T.roles(F.col("annotation")), " ").alias("roles"))


@query
def x13_inline_words(s: SparkSession, d: str) -> DataFrame:
    rows = _segmented(s, d).filter(F.size("morphs") == F.size("annotation"))
    inline = T.inline_form(F.col("morphs"), F.col("annotation"))
    return rows.select("file", inline.alias("inline"), T.break_inline(inline).alias("joined")).distinct()


# ---------------------------------------------------------------- merging, coverage, truncation


@query
def a1_merged(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d)


@query
def a3_merge_report(s: SparkSession, d: str) -> DataFrame:
    return _round(frequency.merge_report(_lines(s, d)), "avg_stripped", places=4)


@query
def a4_totals(s: SparkSession, d: str) -> DataFrame:
    return frequency.totals(_words(s, d))


@query
def a6_top_share(s: SparkSession, d: str) -> DataFrame:
    return frequency.top_share(_words(s, d))


@query
def w1_ranked(s: SparkSession, d: str) -> DataFrame:
    return frequency.ranked(_words(s, d))


@query
def w3_coverage(s: SparkSession, d: str) -> DataFrame:
    return frequency.coverage(_words(s, d))


@query
def k7_wide_coverage(s: SparkSession, d: str) -> DataFrame:
    """All coverage levels of a language in one row."""
    return frequency.wide_coverage(frequency.coverage(_words(s, d)))


@query
def w4_shares(s: SparkSession, d: str) -> DataFrame:
    """Share of each word in its language and the coverage down to its frequency."""
    spec = frequency.cumulated(frequency.spectrum(_words(s, d)))
    return spec.select("lang", "frequency", "n", rounded(F.col("frequency") / F.col("tokens")).alias("share"), rounded(F.col("tokens_upto") / F.col("tokens")).alias("covered"))


@query
def t2_truncated(s: SparkSession, d: str) -> DataFrame:
    return _round(frequency.truncated(_words(s, d)), "ppm", places=3)


@query
def w10_truncated_by_chance(s: SparkSession, d: str) -> DataFrame:
    """The same with a random choice among the words of the last frequency."""
    return _round(frequency.truncated(_words(s, d), seed=42), "ppm", places=3)


@query
def t3_top_languages(s: SparkSession, d: str) -> DataFrame:
    return frequency.top_languages(_words(s, d), 5)


@query
def p4_list_languages(s: SparkSession, d: str) -> DataFrame:
    """Tokens of some languages by code or full stem."""
    return frequency.chosen_languages(_words(s, d), ("nan", "dei", "RAI")).groupBy("lang").agg(F.sum("frequency").alias("tokens"))


QUERIES["r4_chosen_languages"] = QUERIES.pop("p4_list_languages")  # names p<N>_ belong to the problems


# ---------------------------------------------------------------- filters


@query
def a7_hapaxes(s: SparkSession, d: str) -> DataFrame:
    return frequency.hapax_words(_lines(s, d)).groupBy("file").agg(F.count(F.lit(1)).alias("hapaxes"))


@query
def j1_hapax_overlap(s: SparkSession, d: str) -> DataFrame:
    return filters.hapax_overlap(_lines(s, d))


@query
def t4_top_pairs(s: SparkSession, d: str) -> DataFrame:
    return filters.top_pairs(filters.hapax_overlap(_lines(s, d)))


@query
def e8_overlap_ignored(s: SparkSession, d: str) -> DataFrame:
    """Files left out for overlap, with a threshold that suits lists of this size."""
    return filters.overlap_ignored(filters.top_pairs(filters.overlap_above(_lines(s, d), 6.0)), 6.0)


@query
def a9_script_letters(s: SparkSession, d: str) -> DataFrame:
    return filters.script_letters(filters.sampled_lines(_lines(s, d))).select("file", "script", "letters")


@query
def a10_file_scripts(s: SparkSession, d: str) -> DataFrame:
    shares = filters.file_scripts(filters.script_letters(filters.sampled_lines(_lines(s, d))))
    return shares.filter("place = 1").select("file", "script", "total_letters", "pct")


@query
def a11_language_scripts(s: SparkSession, d: str) -> DataFrame:
    return filters.language_scripts(filters.file_scripts(filters.script_letters(filters.sampled_lines(_lines(s, d)))))


def _ignored(s: SparkSession, d: str) -> DataFrame:
    rows = _lines(s, d)
    overlap = filters.overlap_ignored(filters.top_pairs(filters.overlap_above(rows, 6.0)), 6.0)
    shares = filters.file_scripts(filters.script_letters(filters.sampled_lines(rows)))
    return filters.priority_union(overlap, filters.script_ignored(shares))


@query
def e4_ignored(s: SparkSession, d: str) -> DataFrame:
    """Overlap first, then script; the first reason of a file stays."""
    return _ignored(s, d).select("file", "reason")


@query
def j2_without_ignored(s: SparkSession, d: str) -> DataFrame:
    kept = filters.without_ignored(_lines(s, d), _ignored(s, d))
    return kept.groupBy("lang").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("lines"))


# ---------------------------------------------------------------- quality


@query
def a12_quality(s: SparkSession, d: str) -> DataFrame:
    scored = quality.quality(_lines(s, d), quality.expected_scripts(table(s, d, "segmented")))
    return _round(scored.drop("lang"), places=4)


@query
def a19_quality_of_all_files(s: SparkSession, d: str) -> DataFrame:
    """Scores of every delivered file, zero where nothing is usable."""
    scored = quality.quality(_lines(s, d), quality.expected_scripts(table(s, d, "segmented"))).select("file", "program_pct", "total_types")
    return _round(quality.with_empty(scored, table(s, d, "raw_freq").filter("file is not null")), places=4)


# ---------------------------------------------------------------- metrics


@query
def a21_lexical_metrics(s: SparkSession, d: str) -> DataFrame:
    """All lexical metrics of each language's merged list."""
    words = _words(s, d)
    counts = words.select("lang", "word", F.col("frequency").alias("f"), F.lit(1).alias("c"), F.length("word").alias("size"))
    names = ("types", "tokens", "ttr", "freq_hapax_count", "freq_hapax_ratio", "mean_type_length", "mean_token_length", "entropy", "perplexity")
    return _round(metrics.metrics(counts, "lang", names).join(metrics.zipf_slope(words), "lang"), places=4)


@query
def a25_record_metrics(s: SparkSession, d: str) -> DataFrame:
    """Metrics over records: a key's record count decides what is a hapax."""
    return _round(metrics.record_metrics(_lines(s, d)), places=4)


@query
def a32_morph_metrics(s: SparkSession, d: str) -> DataFrame:
    return _round(morphs.morph_metrics(_segmented(s, d)))


@query
def a35_role_metrics(s: SparkSession, d: str) -> DataFrame:
    return _round(morphs.role_metrics(_segmented(s, d)), places=4)


@query
def a31_inline_metrics(s: SparkSession, d: str) -> DataFrame:
    return _round(morphs.inline_metrics(_segmented(s, d).filter(F.size("morphs") == F.size("annotation"))))


# ---------------------------------------------------------------- statistics


@query
def w12_latest_quality(s: SparkSession, d: str) -> DataFrame:
    return _latest_quality(s, d).select("file", "language", "corrupted_pct", "total_types")


@query
def a42_described(s: SparkSession, d: str) -> DataFrame:
    return _round(statistics.described(_latest_quality(s, d), "corrupted_pct", "lang"), places=10)


@query
def a43_histogram(s: SparkSession, d: str) -> DataFrame:
    return statistics.histogram(_latest_quality(s, d), "corrupted_pct", 0.0, 100.0, 20)


@query
def a45_grouped(s: SparkSession, d: str) -> DataFrame:
    return _latest_quality(s, d).groupBy("lang").agg(
        F.count("program_pct").alias("n"), rounded(F.avg("program_pct"), 10).alias("mean"), rounded(F.median("program_pct"), 10).alias("median"),
        rounded(F.stddev_samp("program_pct"), 10).alias("std"), F.count_distinct("script").alias("scripts"),
    )


@query
def a48_pivot(s: SparkSession, d: str) -> DataFrame:
    """Lines of each language by source kind, one column per kind; kinds beyond these are counted together."""
    kinds = ["forum", "law", "letters", "news", "radio", "school", "web", "wiki"]
    kind = F.split_part("file", F.lit("_"), F.lit(2))
    rows = _lines(s, d).withColumn("kind", F.when(kind.isin(kinds), kind).otherwise("other"))
    return rows.groupBy("lang").pivot("kind", [*kinds, "other"]).agg(F.count(F.lit(1))).na.fill(0)


@query
def a49_row_shares(s: SparkSession, d: str) -> DataFrame:
    """Share of each source kind in a language's tokens."""
    rows = _lines(s, d).groupBy("lang", F.split_part("file", F.lit("_"), F.lit(2)).alias("kind")).agg(F.sum("frequency").alias("tokens"))
    return rows.withColumn("share", rounded(F.col("tokens") / F.sum("tokens").over(Window.partitionBy("lang"))))


@query
def a52_normalised(s: SparkSession, d: str) -> DataFrame:
    means = _latest_quality(s, d).groupBy("lang").agg(F.avg("punct_char_pct").alias("value"))
    return _round(statistics.normalised(means, "value"), places=5)


def _language_values(s: SparkSession, d: str) -> DataFrame:
    """(lang, family, genus, typology, value): mean word length of each language of the list that has lines."""
    value = _lines(s, d).groupBy("lang").agg(F.avg(F.length("word")).alias("value"), F.sum("frequency").alias("tokens"), F.count(F.lit(1)).alias("lines"))
    return value.join(table(s, d, "languages").withColumnRenamed("iso_code", "lang"), "lang")


@query
def a53_clustering(s: SparkSession, d: str) -> DataFrame:
    values = _language_values(s, d)
    scores = [statistics.clustering(values, "value", g).withColumn("grouping", F.lit(g)) for g in ("family", "genus", "typology")]
    return _round(frequency.bag_union(*scores), places=5)


@query
def a56_pearson(s: SparkSession, d: str) -> DataFrame:
    return _latest_quality(s, d).agg(
        rounded(statistics.pearson("corrupted_pct", "corrupted_freq_pct")).alias("corrupted"), rounded(statistics.pearson("total_types", "total_frequency")).alias("sizes")
    )


@query
def a57_spearman(s: SparkSession, d: str) -> DataFrame:
    return _round(statistics.spearman(_latest_quality(s, d), "corrupted_pct", "corrupted_freq_pct", "lang"))


@query
def a58_kendall(s: SparkSession, d: str) -> DataFrame:
    values = _language_values(s, d)
    return _round(statistics.kendall(values, "value", "lines", "lang"))


@query
def a59_regression(s: SparkSession, d: str) -> DataFrame:
    y, x = F.log10(F.col("total_types").cast("double")), F.log10(F.col("total_frequency").cast("double"))
    return _latest_quality(s, d).filter("total_types > 0 and total_frequency > 0").groupBy("lang").agg(
        rounded(F.regr_slope(y, x)).alias("slope"), rounded(F.regr_intercept(y, x)).alias("intercept")
    )


def _coverage_points(s: SparkSession, d: str) -> DataFrame:
    """(lang, x, y): share of words that covers a level, by level."""
    whole = F.max(F.when(F.col("level") == 100.0, F.col("types"))).over(Window.partitionBy("lang"))
    long = frequency.coverage(_words(s, d)).withColumn("whole", whole)
    return long.select("lang", F.col("level").alias("x"), (F.col("types") / F.col("whole") * 100).alias("y"))


@query
def a62_least_at_level(s: SparkSession, d: str) -> DataFrame:
    points = _coverage_points(s, d)
    return points.groupBy("x").agg(F.min(F.struct(rounded("y").alias("y"), "lang")).alias("m"), rounded(F.median("y")).alias("median")).select(
        F.col("x").alias("level"), F.col("m.lang").alias("lang"), F.col("m.y").alias("least"), "median"
    )


@query
def w13_crossing(s: SparkSession, d: str) -> DataFrame:
    """The level at which the share of words passes a tenth, interpolated."""
    rising = _coverage_points(s, d).withColumn("v", -F.col("y"))
    return _round(statistics.crossing(rising, "v", -10.0, "lang"), places=4)


@query
def w16_suffix_slopes(s: SparkSession, d: str) -> DataFrame:
    points = _latest_quality(s, d).filter("total_types > 0 and total_frequency > 0").select(
        "lang", F.col("total_frequency").cast("double").alias("x"), F.col("total_types").cast("double").alias("y"), "file"
    )
    logs = points.withColumn("x", F.round(F.log10("x"), 3)).withColumn("y", F.log10("y"))
    return statistics.suffix_slopes(logs, "lang").select("file", rounded("slope_after", 3).alias("slope_after"))


@query
def w17_elbow(s: SparkSession, d: str) -> DataFrame:
    return _round(statistics.elbow(_coverage_points(s, d), "lang"), "sse", places=3)


@query
def w15_sign_changes(s: SparkSession, d: str) -> DataFrame:
    """Levels at which a language's share of words passes the median of all languages."""
    points = _coverage_points(s, d)
    middle = points.groupBy("x").agg(F.median("y").alias("m"))
    above = points.join(F.broadcast(middle), "x").withColumn("v", F.round(F.col("y") - F.col("m"), 9))
    return statistics.sign_changes(above, "v", "lang").select("lang", F.col("x").alias("level"))


@query
def w18_nearest(s: SparkSession, d: str) -> DataFrame:
    """The file whose share of damaged rows is nearest to 2 per cent, per language."""
    rows = _latest_quality(s, d).filter("corrupted_pct is not null")
    near = F.min(F.struct(F.round(F.abs(F.col("corrupted_pct") - 2.0), 6).alias("gap"), "file"))
    return rows.groupBy("lang").agg(near.alias("n")).select("lang", "n.file", "n.gap")


@query
def w7_ranking(s: SparkSession, d: str) -> DataFrame:
    """Languages by mean word length: smallest rank, average rank and renumbered place."""
    values = _language_values(s, d).withColumn("value", F.round("value", 2))
    falling = Window.partitionBy(F.lit(0)).orderBy(F.col("value").desc())
    return values.select(
        "lang", "value", F.rank().over(falling).alias("min_rank"), statistics.average_rank("value").alias("avg_rank"),
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("value").desc(), "lang")).alias("place"),
    )


@query
def a68_deviating(s: SparkSession, d: str) -> DataFrame:
    """Languages whose typology is not the usual one of their family."""
    return statistics.deviating(table(s, d, "languages"), "family", "typology").select("iso_code", "family", "typology", "usual")


@query
def a63_differences(s: SparkSession, d: str) -> DataFrame:
    """How the scores of files checked twice differ."""
    rows = table(s, d, "quality").filter("file is not null and corrupted_pct is not null")
    both = rows.groupBy("file").agg((F.max("corrupted_pct") - F.min("corrupted_pct")).alias("diff"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return both.agg(
        F.count(F.lit(1)).alias("files"), rounded(F.avg("diff"), 10).alias("mean"), rounded(F.median("diff"), 10).alias("median"),
        rounded(F.max("diff"), 10).alias("most"), F.count_if(F.col("diff") > 1).alias("over"),
    )


# ---------------------------------------------------------------- joins and reports


def _result_table(s: SparkSession, d: str) -> DataFrame:
    totals = frequency.totals(_words(s, d))
    scores = _latest_quality(s, d).groupBy("lang").agg(F.avg("corrupted_pct").alias("corrupted_pct"), F.count(F.lit(1)).alias("files"))
    names = table(s, d, "languages").withColumnRenamed("iso_code", "lang")
    morph = morphs.morph_metrics(_segmented(s, d)).select(F.substring("file", 1, 3).alias("lang"), F.regexp_extract("file", r"^.{3}_([^-]+)-", 1).alias("segmentor"), "avg_morphs", "compounding_index")
    return report.left_joined(totals, scores, names, morph, on="lang")


@query
def j3_results(s: SparkSession, d: str) -> DataFrame:
    """Totals, quality, list of languages and morph metrics side by side; several segmentors repeat a language."""
    columns = ["lang", "types", "tokens", "corrupted_pct", "files", "name", "family", "segmentor", "avg_morphs", "compounding_index"]
    return _round(_result_table(s, d).select(*columns), places=5)


@query
def k13_latex(s: SparkSession, d: str) -> DataFrame:
    rows = _result_table(s, d).filter("segmentor = 'Morfo'").withColumn("avg_morphs", F.round("avg_morphs", 5))
    return report.latex_rows(rows, ("lang", "name"), ("types", "tokens"), ("avg_morphs",)).select("lang", "line")


@query
def j18_code_of_names(s: SparkSession, d: str) -> DataFrame:
    """Codes of exactly typed names: the entry's own code first, then the list's."""
    typed = table(s, d, "lepzig_shortcuts").filter("language is not null").select("entry_id", F.col("language").alias("name"), "code")
    names = table(s, d, "languages").select("name", F.col("iso_code").alias("listed"))
    return typed.join(names, "name").select("entry_id", F.coalesce("code", "listed").alias("code"))


@query
def e1_code_sets(s: SparkSession, d: str) -> DataFrame:
    """Codes in both the list of languages and the lists of words, in one of them only, or in either."""
    listed = table(s, d, "languages").select(F.col("iso_code").alias("code")).distinct()
    used = table(s, d, "raw_freq").filter("file is not null").select(F.substring("file", 1, 3).alias("code")).distinct()
    parts = {"both": listed.intersect(used), "only_listed": listed.exceptAll(used), "only_used": used.exceptAll(listed), "either": listed.union(used).distinct()}
    return frequency.bag_union(*(frame.select("code", F.lit(kind).alias("kind")) for kind, frame in parts.items()))


@query
def t5_largest(s: SparkSession, d: str) -> DataFrame:
    """The five files with the most tokens of each language, and the place of each."""
    sizes = _lines(s, d).groupBy("lang", "file").agg(F.sum("frequency").alias("tokens"))
    order = Window.partitionBy("lang").orderBy(F.col("tokens").desc(), "file")
    return sizes.withColumn("place", F.row_number().over(order)).filter("place <= 5")


@query
def u4_segmented_by_two(s: SparkSession, d: str) -> DataFrame:
    ship_package(s)
    return segment.segmented_words(_words(s, d), segment.every_two)


@query
def u5_compression(s: SparkSession, d: str) -> DataFrame:
    ship_package(s)
    return compress.averaged(compress.compression(_words(s, d)))
