"""Column functions on encyclopedia text: titles, marks, dates, speaker counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_key(text: Column) -> Column:
    """Lower case, runs of other signs as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def base_name(title: Column) -> Column:
    """A title without what stands in brackets or after a comma, and without the word 'language'."""
    bare = F.regexp_replace(title, r"\s*\([^)]*\)|,.*$", "")
    return F.trim(F.regexp_replace(bare, r"(?i)\s+languages?$", ""))


def title_candidates(name: Column) -> Column:
    """Titles to try, each once whatever its case."""
    base = base_name(name)
    tries = F.array(name, F.concat(base, F.lit(" language")), base)
    return F.filter(tries, lambda t, i: F.array_position(F.transform(tries, lambda x: F.lower(x)), F.lower(t)) == i + 1)


def title_of_url(url: Column) -> Column:
    return F.replace(F.url_decode(F.regexp_extract(url, r"/wiki/([^?#]+)", 1)), F.lit("_"), F.lit(" "))


def url_of_title(title: Column, site: str) -> Column:
    return F.concat(F.lit(f"https://{site}/wiki/"), F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))))


def plain_wikitext(text: Column) -> Column:
    """Without references, comments, tags, simple templates and link marks."""
    out = text
    for pattern, put in (
        (r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", ""), (r"<br\s*/?>", ", "), (r"<[^>]+>", ""),
        (r"\{\{[^{}]*\}\}", ""), (r"\{\{[^{}]*\}\}", ""), (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"), (r"\[https?://\S+\s*([^\]]*)\]", "$1"),
        (r"'{2,}", ""), (r"&nbsp;", " "), (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out)


def dates_in_brackets(text: Column) -> Column:
    """The years in brackets of a text."""
    return F.regexp_extract_all(text, F.lit(r"\(([^()]*\b(?:1[5-9]|20)\d\d\b[^()]*)\)"), F.lit(1))


def speaker_count(text: Column) -> Column:
    """The first count of a text as a number: thousands separators, words for powers of ten, ranges by their middle."""
    shown = F.regexp_replace(text, r"(?<=\d)[,\x{a0} ](?=\d{3}\b)", "")
    number = r"(\d+(?:\.\d+)?)"
    unit = r"\s*(thousand|million|billion)?"
    found = rf"(?i){number}(?:\s*[-\x{{2013}}]\s*{number})?{unit}"
    low = F.nullif(F.regexp_extract(shown, found, 1), F.lit("")).cast("double")
    high = F.nullif(F.regexp_extract(shown, found, 2), F.lit("")).cast("double")
    word = F.lower(F.regexp_extract(shown, found, 3))
    factor = F.when(word == "thousand", 1e3).when(word == "million", 1e6).when(word == "billion", 1e9).otherwise(1.0)
    return (low + F.coalesce(high, low)) / 2 * factor


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def safe_stem(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"[^\w\-.]+", "_")
