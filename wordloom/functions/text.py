"""Column functions on words: cleaning, letters, scripts, web leftovers, morph roles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs taken off both ends of a word.
STRIP_CHARS = '.,?!":()…“ ”„‟‘’«»'
# Signs taken off both ends of a word of running text.
TEXT_STRIP_CHARS = ".,;:!?\"'()[]{}«»—–-…·"
# Signs counted as punctuation in words.
KNOWN_PUNCT = '".,?!;:/\\@#$%^&*~`<>|+=_()[]{}'
# English words that tell of foreign text.
ENGLISH_WORDS = ("the", "with", "there", "that", "will", "which", "after", "would", "people", "other", "where", "years", "because", "against", "however")
# Codes of the Unicode scripts that are told apart, and their names.
SCRIPT_CODES = {
    "Latn": "Latin", "Grek": "Greek", "Cyrl": "Cyrillic", "Armn": "Armenian", "Hebr": "Hebrew", "Arab": "Arabic", "Syrc": "Syriac", "Thaa": "Thaana",
    "Deva": "Devanagari", "Beng": "Bengali", "Guru": "Gurmukhi", "Gujr": "Gujarati", "Orya": "Oriya", "Taml": "Tamil", "Telu": "Telugu", "Knda": "Kannada",
    "Mlym": "Malayalam", "Sinh": "Sinhala", "Thai": "Thai", "Laoo": "Lao", "Tibt": "Tibetan", "Mymr": "Myanmar", "Geor": "Georgian", "Hang": "Hangul",
    "Ethi": "Ethiopic", "Cher": "Cherokee", "Cans": "Canadian_Aboriginal", "Ogam": "Ogham", "Runr": "Runic", "Khmr": "Khmer", "Mong": "Mongolian",
    "Hira": "Hiragana", "Kana": "Katakana", "Hani": "Han", "Bugi": "Buginese", "Bali": "Balinese", "Yiii": "Yi", "Tale": "Tai_Le", "Talu": "New_Tai_Lue",
    "Tfng": "Tifinagh", "Vaii": "Vai", "Ital": "Old_Italic", "Goth": "Gothic", "Dsrt": "Deseret", "Cprt": "Cypriot", "Olck": "Ol_Chiki",
}
SCRIPTS = tuple(SCRIPT_CODES.values())
# Kinds of scripts by code; the kind of others is not known.
SCRIPT_TYPES = {
    "Latn": "alphabet", "Grek": "alphabet", "Cyrl": "alphabet", "Armn": "alphabet", "Hebr": "abjad", "Arab": "abjad", "Thaa": "abjad", "Deva": "abugida",
    "Beng": "abugida", "Guru": "abugida", "Gujr": "abugida", "Orya": "abugida", "Taml": "abugida", "Telu": "abugida", "Knda": "abugida", "Mlym": "abugida",
    "Sinh": "abugida", "Thai": "abugida", "Geor": "alphabet", "Hang": "syllabary", "Ethi": "ethiopic", "Cans": "syllabary", "Hani": "logographic",
}
#: Groups of scripts by code; others are 'Other'.
SCRIPT_GROUPS = {
    "Latin": ("Latn",), "Cyrillic": ("Cyrl",), "Other Alphabet": ("Grek", "Armn", "Geor"), "Arabic": ("Arab",), "Other Abjad": ("Hebr", "Syrc", "Thaa"),
    "Indic": ("Deva", "Beng", "Guru", "Gujr", "Orya", "Taml", "Telu", "Knda", "Mlym", "Sinh"), "Ethiopic": ("Ethi",), "Syllabic": ("Cans", "Cher", "Vaii"),
    "CJK": ("Hani", "Hira", "Kana", "Hang"),
}


def has_letter(word: Column) -> Column:
    """Letters and numbers other than decimal digits count as letters."""
    return word.rlike(r"[\p{L}\p{Nl}\p{No}]")


def stripped(word: Column) -> Column:
    return F.btrim(word, F.lit(STRIP_CHARS))


def clean_text_word(word: Column) -> Column:
    """A word of running text without signs at its ends, in lower case; null if no letter is left."""
    key = F.lower(F.btrim(word, F.lit(TEXT_STRIP_CHARS)))
    return F.when(has_letter(key), key)


def clean_word(word: Column) -> Column:
    """The word without signs at its ends, in lower case; null if no letter is left."""
    key = F.lower(stripped(word))
    return F.when(has_letter(key), key)


def script_of(ch: Column) -> Column:
    """The script of a letter, 'Other' for scripts that are not told apart."""
    out = F.lit("Other")
    for name in reversed(SCRIPTS):
        out = F.when(ch.rlike(rf"\p{{Is{name}}}"), name).otherwise(out)
    return out


def dominant_script(word: Column) -> Column:
    """The script with the most letters, of equal ones the first seen; 'Common' without letters of a known script."""
    letters = F.filter(F.split(word, ""), lambda ch: ch.rlike(r"\p{L}"))
    found = F.filter(F.transform(letters, script_of), lambda s: s != "Other")
    # the least (minus count, place) is the first of the most frequent
    ranked = F.transform(F.array_distinct(found), lambda s, i: F.struct((-F.size(F.filter(found, lambda x: x == s))).alias("n"), i.alias("i"), s.alias("s")))
    ascii_only = F.when(word.rlike("[A-Za-z]"), "Latin").otherwise("Common")
    return F.when(word.rlike(r"\A[\x00-\x7F]*\z"), ascii_only).otherwise(F.coalesce(F.array_min(ranked)["s"], F.lit("Common")))


_PUNCT_CLASS = "[" + re.escape(KNOWN_PUNCT) + "]"


def punct_signs(word: Column) -> Column:
    """How many signs of a word are known punctuation."""
    return F.length(word) - F.length(F.regexp_replace(word, _PUNCT_CLASS, ""))


def is_program(word: Column) -> Column:
    """Whether a word looks like a web address or a piece of a program."""
    many = lambda sign: F.length(word) - F.length(F.replace(word, F.lit(sign), F.lit(""))) > 1
    return F.lower(word).rlike("www|http") | word.rlike(r"[{}\\@]") | many(".") | many(",")


def ppm(frequency: Column, total: Column) -> Column:
    return frequency / total * F.lit(1e6)


def roles(annotation: Column) -> Column:
    """Per morph: 'root', 'prefix' (affix before the first root), 'suffix' (after the last) or 'interfix'.

    Without a root every affix is an 'interfix': it is neither before nor after one.
    """
    places = F.filter(F.transform(annotation, lambda a, i: F.when(a == "R", i)), lambda i: i.isNotNull())
    first, last = F.array_min(places), F.array_max(places)
    return F.transform(
        annotation,
        lambda a, i: F.when(a == "R", "root").when(i < first, "prefix").when(i > last, "suffix").otherwise("interfix"),
    )


def inline_form(morphs: Column, annotation: Column) -> Column:
    """Morphs as one text with blanks between and '@' before roots."""
    pairs = F.arrays_zip(morphs.alias("m"), annotation.alias("a"))
    return F.array_join(F.transform(pairs, lambda p: F.when(p["a"] == "R", F.concat(F.lit("@"), p["m"])).otherwise(p["m"])), " ")


def break_inline(word: Column) -> Column:
    """An inline-segmented word without its '@' marks (a lone '@' stays)."""
    parts = F.split(word, r"\s+")
    return F.array_join(F.transform(parts, lambda m: F.when(m.rlike("^@."), F.substring(m, 2, 1 << 30)).otherwise(m)), "")


def abbreviated(number: Column) -> Column:
    """1234 as 1.2K, and so on for M and B."""
    shown = lambda unit, sign: F.concat(F.format_string("%.1f", number / unit), F.lit(sign))
    return (
        F.when(number >= 1e9, shown(1e9, "B")).when(number >= 1e6, shown(1e6, "M")).when(number >= 1e3, shown(1e3, "K")).otherwise(number.cast("bigint").cast("string"))
    )


def latex_escaped(text: Column) -> Column:
    out = text
    for sign in "&%_":
        out = F.replace(out, F.lit(sign), F.lit("\\" + sign))
    return out


def coverage_column(level: float) -> str:
    """Name of a coverage level's column: 90.5 is cov_90_5."""
    return "cov_" + f"{level:g}".replace(".", "_")
