"""Information in word structure: how much better words compress than words with shuffled letters."""

from __future__ import annotations

import random
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.frequency import ranked

#: Tokens drawn for one run; a group never holds more rows than this.
SAMPLE = 20_000
#: Runs that are averaged.
RUNS = 6


def characters(words: DataFrame) -> DataFrame:
    """The distinct characters of all words, in order."""
    return words.select(F.explode(F.split("word", "")).alias("ch")).filter("ch <> ''").distinct().orderBy("ch")


#: Parts of equal width into which a language's tokens are cut to look up draws.
PARTS = 1 << 16


def drawn_tokens(words: DataFrame, runs: int, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(lang, run, word, times): ``sample`` tokens of each language and run, drawn with replacement.

    A draw is a place among the language's tokens, ordered as ``ranked`` orders them, by the md5 of
    language, run, number and seed. Words and draws meet in parts of equal width, so that no language
    passes through one task.
    """
    places = ranked(words).select("lang", "word", (F.col("tokens_upto") - F.col("frequency")).alias("start"), F.col("tokens_upto").alias("stop"))
    total = words.groupBy("lang").agg(F.sum("frequency").alias("total")).withColumn("width", F.ceil(F.col("total") / PARTS))
    each = total.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(sample - 1))))
    digest = F.md5(F.concat_ws(":", "lang", "run", "draw", F.lit(str(seed))))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.col("total")
    draws = each.select("lang", "run", place.alias("place"), F.floor(place / F.col("width")).alias("part"))
    first, last = F.floor(F.col("start") / F.col("width")), F.floor((F.col("stop") - 1) / F.col("width"))
    spread = places.join(total, "lang").select("lang", "word", "start", "stop", F.explode(F.sequence(first, last)).alias("part"))
    hit = draws.join(spread, ["lang", "part"]).filter((F.col("start") <= F.col("place")) & (F.col("place") < F.col("stop")))
    return hit.groupBy("lang", "run", "word").agg(F.count(F.lit(1)).cast("int").alias("times"))


def sample_sizes(drawn: DataFrame) -> DataFrame:
    """(lang, run, unique_chars, tokens, bin_size) of drawn tokens with two bytes for each sign and between tokens."""
    sizes = drawn.groupBy("lang", "run").agg(F.sum("times").alias("tokens"), (2 * F.sum(F.length("word") * F.col("times")) + 2 * (F.sum("times") - 1)).alias("bin_size"))
    signs = drawn.select("lang", "run", F.explode(F.split("word", "")).alias("ch")).filter("ch <> ''").distinct().groupBy("lang", "run").agg(F.count(F.lit(1)).alias("unique_chars"))
    return sizes.join(signs, ["lang", "run"])


def compression(words: DataFrame, runs: int = RUNS, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(lang, run, unique_chars, tokens, bin_size, zip_size, rand_zip_size, ratio, reduction_pct)."""
    out = "lang string, run int, unique_chars int, tokens int, bin_size int, zip_size int, rand_zip_size int, ratio double, reduction_pct double"

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("word")
        draw = random.Random(f"{seed}:{group['lang'].iloc[0]}:{group['run'].iloc[0]}")
        tokens = [w for w, n in zip(group["word"], group["times"], strict=True) for _ in range(n)]
        draw.shuffle(tokens)
        signs = sorted({ch for w in tokens for ch in w})
        code = {ch: n.to_bytes(2, "big") for ch, n in zip(signs, draw.sample(range(1, 1 << 16), len(signs)), strict=True)}
        encode = lambda words: b"\0\0".join(b"".join(code[ch] for ch in w) for w in words)
        data = encode(tokens)
        mixed = encode("".join(draw.sample(w, len(w))) for w in tokens)
        small, mixed_small = len(zlib.compress(data, 9)), len(zlib.compress(mixed, 9))
        row = (group["lang"].iloc[0], int(group["run"].iloc[0]), len(signs), len(tokens), len(data), small, mixed_small)
        return pd.DataFrame([(*row, small / max(1, len(data)), 100.0 * (mixed_small - small) / max(1, mixed_small))], columns=[c.split()[0] for c in out.split(", ")])

    return drawn_tokens(words, runs, sample, seed).groupBy("lang", "run").applyInPandas(measure, out)


def averaged_sizes(runs: DataFrame) -> DataFrame:
    """Means of the sizes over the runs of each language."""
    return runs.groupBy("lang").agg(*(F.round(F.avg(c)).cast("bigint").alias(c) for c in ("unique_chars", "tokens", "bin_size")))


def averaged(runs: DataFrame) -> DataFrame:
    """Means over the runs of each language."""
    numbers = ("unique_chars", "tokens", "bin_size", "zip_size", "rand_zip_size")
    return runs.groupBy("lang").agg(*(F.round(F.avg(c)).cast("bigint").alias(c) for c in numbers), *(F.round(F.avg(c), 4).alias(c) for c in ("ratio", "reduction_pct")))
