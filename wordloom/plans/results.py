"""The result table: one row per language and segmentor with all counts and metrics, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import compress, frequency, metrics, report
from wordloom.operators.frequency import rounded
from wordloom.plans.oracle import _ENTROPY, ORACLE, RANKED, SEG
from wordloom.plans.queries import QUERIES as CORE
from wordloom.plans.queries import _segmented, _words
from wordloom.session import ship_package
from wordloom.sources.tables import table

#: Metrics of words and of morphs in the table, by their names in ``metrics.METRICS``.
ITEM_METRICS = {
    "ttr": "ttr", "entropy": "entropy", "perplexity": "perplexity", "type_entropy": "type_entropy", "type_perplexity": "type_perplexity",
    "hapax_ratio": "hapax_ratio", "avg_length": "mean_type_length", "avg_length_weighted": "mean_token_length",
}
PARTS = ("morphs", "roots", "affixes", "prefixes", "suffixes")
ROLES = ("root", "affix", "prefix", "suffix")

#: The columns of the table, in order.
COLUMNS = (
    "lang", "script", "script_type", "segmentor", "language_name", "family", "genus", "typology", "dominant_script_pct",
    "original_token_count", "original_type_count", "current_token_count", "current_type_count", "last_type_frequency",
    "type_token_ratio", "corpus_zipf_slope", "token_frequency_entropy", "token_frequency_perplexity", "avg_type_length", "avg_token_length",
    "hapax_type_ratio", "single_token_type_ratio", "word_count", "word_total_frequency", "word_ttr", "word_entropy", "word_perplexity",
    "word_zipf_slope", "morph_zipf_slope", "word_hapax_ratio", "morph_hapax_ratio", "word_avg_length", "word_avg_length_weighted",
    "morph_count", "morph_total_frequency", "morph_ttr", "morph_entropy", "morph_perplexity", "morph_type_entropy", "morph_type_perplexity",
    "morph_avg_length", "morph_avg_length_weighted", *(f"avg_{p}_per_word" for p in PARTS), "compounding_index", "affix_deviation",
    *(f"avg_{p}_per_word_weighted" for p in PARTS), "compounding_index_weighted", "affix_deviation_weighted",
    *(f"{r}_entropy" for r in ROLES), *(f"{r}_type_entropy" for r in ROLES), *(f"{r}_count" for r in ROLES),
)


def _renamed(frame: DataFrame, **names: str) -> DataFrame:
    """The columns named on the right under the names on the left."""
    return frame.select(*(F.col(old).alias(new) for new, old in names.items()))


def _items(rows: DataFrame, item: str, kind: str) -> DataFrame:
    """Metrics of each file's words or morphs, named after their kind."""
    counts = metrics.keyed_counts(rows, "file", item)
    values = metrics.metrics(counts, "file", ("types", *ITEM_METRICS.values()))
    slope = metrics.zipf_slope(counts.select(F.col("file").alias("lang"), F.col(item).alias("word"), F.col("f").alias("frequency"))).withColumnRenamed("lang", "file")
    both = values.join(slope, "file", "left")
    return both.select("file", F.col("types").alias(f"{kind}_types"), F.col("zipf_slope").alias(f"{kind}_zipf_slope"), *(F.col(old).alias(f"{kind}_{new}") for new, old in ITEM_METRICS.items()))


def _by_file(s: SparkSession, d: str) -> DataFrame:
    rows = _segmented(s, d)
    morphs = rows.select("file", F.explode("morphs").alias("morph"), "frequency")
    roles = CORE["a35_role_metrics"](s, d).groupBy("file").agg(
        *(F.max(F.when(F.col("role") == role, F.col(what))).alias(f"{role}_{name}") for role in ROLES for what, name in (("entropy", "entropy"), ("type_entropy", "type_entropy"), ("morphs", "count")))
    )
    words = _renamed(
        CORE["a32_morph_metrics"](s, d), file="file", word_count="words", word_total_frequency="word_tokens", morph_total_frequency="morph_tokens",
        **{f"avg_{p}_per_word": f"avg_{p}" for p in PARTS}, **{f"avg_{p}_per_word_weighted": f"weighted_{p}" for p in PARTS},
        compounding_index="compounding_index", affix_deviation="affix_deviation", compounding_index_weighted="weighted_compounding_index", affix_deviation_weighted="weighted_affix_deviation",
    )
    both = report.left_joined(words, _items(rows, "word", "word"), _items(morphs, "morph", "morph"), roles, on="file").withColumnRenamed("morph_types", "morph_count")
    code = F.nullif(F.regexp_extract("file", r"_([A-Z][a-z]{3})\.tsv$", 1), F.lit(""))
    types = F.create_map(*(F.lit(x) for pair in T.SCRIPT_TYPES.items() for x in pair))
    return both.select("*", F.substring("file", 1, 3).alias("lang"), code.alias("script"), types[code].alias("script_type"), F.regexp_extract("file", r"^.{3}_([^-]+)-", 1).alias("segmentor"))


def k11_result_table(s: SparkSession, d: str) -> DataFrame:
    """All measures of each language, one row per segmentor; languages without segmented words have nulls there."""
    words = _words(s, d)
    whole = _renamed(frequency.totals(words), lang="lang", original_type_count="types", original_token_count="tokens")
    cut = frequency.truncated(words).groupBy("lang").agg(
        F.count(F.lit(1)).alias("current_type_count"), F.sum("frequency").alias("current_token_count"), F.min("frequency").alias("last_type_frequency"),
        (F.count(F.lit(1)) / F.sum("ppm")).alias("type_token_ratio"),
    )
    lexical = _renamed(
        CORE["a21_lexical_metrics"](s, d), lang="lang", corpus_zipf_slope="zipf_slope", token_frequency_entropy="entropy", token_frequency_perplexity="perplexity",
        avg_type_length="mean_type_length", avg_token_length="mean_token_length", single_token_type_ratio="freq_hapax_ratio",
    )
    records = _renamed(CORE["a25_record_metrics"](s, d), lang="lang", hapax_type_ratio="hapax_ratio")
    script = _renamed(CORE["a11_language_scripts"](s, d).filter("place = 1"), lang="lang", dominant_script_pct="share_pct")
    names = _renamed(table(s, d, "languages"), lang="iso_code", language_name="name", family="family", genus="genus", typology="typology")
    joined = report.left_joined(whole, cut, lexical, records, script, names, _by_file(s, d), on="lang")
    doubles = {f.name for f in joined.schema.fields if f.dataType.typeName() == "double"}
    return joined.select(*(rounded(c, 4).alias(c) if c in doubles else F.col(c) for c in COLUMNS))


def j5_with_compression(s: SparkSession, d: str) -> DataFrame:
    """The same with how much better words compress than words of shuffled letters."""
    ship_package(s)
    packed = _renamed(compress.averaged(compress.compression(_words(s, d))), lang="lang", compress_ratio="ratio", compress_reduction_pct="reduction_pct")
    return report.left_joined(k11_result_table(s, d), packed, on="lang")


def a23_truncated_ttr(s: SparkSession, d: str) -> DataFrame:
    """Words of a truncated list for each of its parts per million."""
    cut = frequency.truncated(_words(s, d))
    return cut.groupBy("lang").agg(rounded(F.count(F.lit(1)) / F.sum("ppm"), 6).alias("ttr"))


def u5_sample_sizes(s: SparkSession, d: str) -> DataFrame:
    """Sizes of the samples that are compressed: tokens, different signs and bytes, means over the runs."""
    return compress.averaged_sizes(compress.sample_sizes(compress.drawn_tokens(_words(s, d), compress.RUNS)))


QUERIES = {f.__name__: f for f in (k11_result_table, j5_with_compression, a23_truncated_ttr, u5_sample_sizes)}


def _item_sql(name: str, item: str) -> str:
    e, t = _ENTROPY.format("f"), _ENTROPY.format("c")
    return f"""{name} as (select file, count(*)::bigint as types, count(*) / sum(f) as ttr, {e} as entropy, pow(2.0, {e}) as perplexity, {t} as type_entropy,
      pow(2.0, {t}) as type_perplexity, count(*) filter (where c = 1) / count(*)::double as hapax_ratio, avg(length(item)) as avg_length, sum(length(item) * f) / sum(f) as avg_length_weighted,
      case when count(*) > 1 then regr_slope(ln(f), ln(place::double)) end as zipf_slope
      from (select *, row_number() over (partition by file order by f desc, item) as place from ({item})) group by file)"""


def _sql() -> str:
    listed = {
        "original_token_count": "t.tokens", "original_type_count": "t.types", "current_token_count": "cut.tokens", "current_type_count": "cut.types", "last_type_frequency": "cut.least",
        "type_token_ratio": "round(cut.ttr, 4)", "corpus_zipf_slope": "x.zipf_slope", "token_frequency_entropy": "x.entropy", "token_frequency_perplexity": "x.perplexity",
        "avg_type_length": "x.mean_type_length", "avg_token_length": "x.mean_token_length", "hapax_type_ratio": "r.hapax_ratio", "single_token_type_ratio": "x.freq_hapax_ratio",
        "lang": "t.lang", "dominant_script_pct": "d.share_pct", "language_name": "l.name", "family": "l.family", "genus": "l.genus", "typology": "l.typology",
        "script": "m.script", "segmentor": "m.segmentor", "script_type": "case m.script " + " ".join(f"when '{c}' then '{n}'" for c, n in T.SCRIPT_TYPES.items()) + " end",
        "word_count": "m.words", "word_total_frequency": "round(m.word_tokens, 4)", "morph_total_frequency": "round(m.morph_tokens, 4)", "morph_count": "mm.types",
        "compounding_index": "round(m.compounding_index, 4)", "affix_deviation": "round(m.affix_deviation, 4)",
        "compounding_index_weighted": "round(m.weighted_compounding_index, 4)", "affix_deviation_weighted": "round(m.weighted_affix_deviation, 4)",
    }
    listed |= {f"avg_{p}_per_word": f"round(m.avg_{p}, 4)" for p in PARTS} | {f"avg_{p}_per_word_weighted": f"round(m.weighted_{p}, 4)" for p in PARTS}
    listed |= {f"{kind}_{name}": f"round({a}.{name}, 4)" for kind, a in (("word", "w"), ("morph", "mm")) for name in (*ITEM_METRICS, "zipf_slope")}
    listed |= {f"{role}_{name}": f"p.{role}_{name}" for role in ROLES for name in ("entropy", "type_entropy", "count")}
    roles = ", ".join(f"max({what}) filter (where role = '{role}') as {role}_{name}" for role in ROLES for what, name in (("entropy", "entropy"), ("type_entropy", "type_entropy"), ("morphs", "count")))
    words = "select file, word as item, sum(frequency) as f, count(*)::double as c from seg group by 1, 2"
    morphs = "select file, item, sum(frequency) as f, count(*)::double as c from (select file, unnest(morphs) as item, frequency from parts) group by 1, 2"
    return f"""with {SEG}, {_item_sql("w", words)}, {_item_sql("mm", morphs)},
      cut as (select lang, count(*)::bigint as types, sum(frequency)::bigint as tokens, min(frequency) as least, count(*) / sum(ppm) as ttr from ({ORACLE["t2_truncated"]}) group by lang),
      p as (select file, {roles} from ({ORACLE["a35_role_metrics"]}) group by file),
      m as (select *, substr(file, 1, 3) as lang, nullif(regexp_extract(file, '_([A-Z][a-z]{{3}})\\.tsv$', 1), '') as script, regexp_extract(file, '^.{{3}}_([^-]+)-', 1) as segmentor
        from ({ORACLE["a32_morph_metrics"]}))
      select {", ".join(f"{listed[c]} as {c}" for c in COLUMNS)} from ({ORACLE["a4_totals"]}) t left join cut using (lang) left join ({ORACLE["a21_lexical_metrics"]}) x using (lang)
      left join ({ORACLE["a25_record_metrics"]}) r using (lang) left join (select * from ({ORACLE["a11_language_scripts"]}) where place = 1) d using (lang)
      left join languages l on l.iso_code = t.lang left join m on m.lang = t.lang left join w on w.file = m.file left join mm on mm.file = m.file left join p on p.file = m.file"""


SQL = {
    "u5_sample_sizes": f"""with {RANKED}, tot as (select lang, max(tokens)::bigint as total from ranked group by lang),
      draws as (select lang, run, ('0x' || substr(md5(lang || ':' || run || ':' || draw || ':42'), 1, 15))::bigint % total as place from tot, range({compress.RUNS}) r(run), range({compress.SAMPLE}) d(draw)),
      starts as (select lang, word, (tokens_upto - frequency)::bigint as start from ranked),
      drawn as (select d.lang, d.run, r.word from draws d asof join starts r on d.lang = r.lang and d.place >= r.start),
      sizes as (select lang, run, count(*) as tokens, 2 * sum(length(word)) + 2 * (count(*) - 1) as bin_size from drawn group by 1, 2),
      signs as (select lang, run, count(distinct ch) as unique_chars from (select lang, run, unnest(string_split(word, '')) as ch from (select distinct lang, run, word from drawn)) group by 1, 2)
      select lang, round(avg(unique_chars))::bigint as unique_chars, round(avg(tokens))::bigint as tokens, round(avg(bin_size))::bigint as bin_size from sizes join signs using (lang, run) group by lang""",
    "k11_result_table": _sql(),
    "a23_truncated_ttr": f"select lang, round(count(*) / sum(ppm), 6) as ttr from ({ORACLE['t2_truncated']}) group by lang",
}
