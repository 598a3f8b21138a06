"""Problem 2: text that was read in another character encoding than it was written in.

Method. Words are joined with clean near-twins of their language on what a wrong decoding leaves of
them: the text stripped of non-ASCII characters (a mark stands where signs were taken out), or, where
no ASCII letter is left, the pattern in which its units (one to three signs each) repeat. The twins
are aligned stretch by stretch, and the substitutions (what stands in the garbled word, what stands in
the twin) are counted over all languages. Substitutions that enough words show are the learned
mapping. It is split into transformations by the pair of encodings that makes all substitutions of an
aligned word; that pair also names the transformation and supplies letters that no twin has shown.
Substitutions that no listed pair of encodings makes are kept as a transformation of their own.

The mapping is applied to all remaining words: a word is found if it holds a learned stretch and is
not legible as it stands; where it is legible both ways the vocabulary and the letter pairs decide.
Apart from that only traces of lost bytes (U+FFFD, C1 controls) tell of a wrong decoding. Each
distinct word is judged once; verdicts are joined back to the rows.

What is collected to the driver is bounded by the number of languages (three-letter codes), letters,
substitutions of letters, and buckets of letter pairs, not by the number of words.

Edge cases: null words and files are never found; an empty table gives no rows; a word with the
replacement sign U+FFFD is found but has no original; repeated rows are found each; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import forms
from wordloom.session import stored

#: A sign of a language's script counts as one of its letters if this many different words hold it. Other signs make
#: a word be looked at, not found.
LETTER_WORDS = 3
#: A transformation is kept for a language if this many of its words show it, and for all languages if as many of all
#: words and this share of them do.
LEAST_WORDS, LEAST_SHARE = 3, 0.0
#: A substitution is learned if it makes up this share of what its stretch stands for; one that no listed pair of
#: encodings makes needs more words and a larger share.
UNIT_SHARE, UNNAMED_WORDS, UNNAMED_SHARE = 0.2, 5, 0.5
#: A letter that stands for another letter of its script does so in this share of its words with such twins.
LETTER_SHARE = 0.8
#: A pair of encodings tells about words without ASCII letters if this share of the legible texts that it makes of a
#: language's words are words of it.
WORD_SHARE = 0.2
#: Votes of twins are counted in so many parts of a word.
PARTS = 1_000_000
#: Signs that one letter may have become, in words without ASCII letters.
WIDTHS = (1, 2, 3)
#: Stands for a stretch of non-ASCII characters in stripped text.
GAP = "\x01"
LOST_BYTES = "lost bytes"


@dataclass
class Study:
    """What the vocabulary tells about each language."""

    languages: dict[str, tuple[str, str]]  # code -> (script, letters)
    pairs: dict[str, tuple[dict[int, int], dict[str, int]]] = field(default_factory=dict)  # code -> counts by bucket of pair and by first letter
    chains: frozenset[str] = frozenset()  # kept for all languages
    local: dict[str, frozenset[str]] = field(default_factory=dict)  # code -> kept for this language
    strange: frozenset[tuple[str, str]] = frozenset()  # learned substitutions (stretch, letter) that no chain makes
    capitals: frozenset[str] = frozenset()  # languages of which capitals stand for other letters

    def kept(self, code: str) -> frozenset[str]:
        """The transformations of one language."""
        return self.chains | self.local.get(code, frozenset())

    def foreign(self) -> dict[str, frozenset[str]]:
        """Letters of all languages by script."""
        out: dict[str, set[str]] = defaultdict(set)
        for script, letters in self.languages.values():
            out[script].update(letters)
        return {script: frozenset(letters) for script, letters in out.items()}

    def frame(self, like: DataFrame) -> DataFrame:
        """(lang, letters, latin, cased, marks), one row per language; letters are in lower case.

        cased: capitals may be other letters of the language that a wrong encoding shows so.
        marks: the letters hold combining marks or other signs that join.
        """
        rows = []
        for code, (script, letters) in sorted(self.languages.items()):
            marks = any(forms.unicodedata.category(ch)[0] == "M" or "ᄀ" <= ch <= "ᇿ" for ch in letters)
            rows.append((code, letters, script == "LATIN", code in self.capitals, marks))
        return like.sparkSession.createDataFrame(rows, "lang string, letters string, latin boolean, cased boolean, marks boolean")


def lang_of(file: str | Column = "file") -> Column:
    return F.substring(file, 1, 3)


def vocabulary(raw_freq: DataFrame) -> DataFrame:
    """(lang, word, n): the distinct words of each language with their lines, written for several passes."""
    words = raw_freq.filter(F.col("word").isNotNull() & F.col("file").isNotNull())
    return stored(words.groupBy(lang_of().alias("lang"), "word").agg(F.count(F.lit(1)).alias("n")))


def study_letters(vocab: DataFrame) -> dict[str, tuple[str, str]]:
    """code -> (script, letters beyond ASCII)."""
    totals = vocab.groupBy("lang").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("word").rlike("[A-Za-z]"), F.col("n")).otherwise(0)).alias("ascii")
    )
    signs = F.array_distinct(F.split(F.regexp_replace(F.lower("word"), r"[\x00-\x7F]+", ""), ""))
    # words of letters only tell about letters, and marks only where they stay marks
    # bytes and signs are as many in ASCII text
    telling = (F.octet_length("word") != F.length("word")) & ~F.col("word").rlike(r"[^\x00-\x7F\p{L}\p{M}]|[ªº]")
    chars = (
        vocab.filter(telling & ~(F.col("word").rlike(r"\p{M}") & F.col("word").rlike(forms.COMPOSABLE)))
        .select("lang", "n", F.explode(signs).alias("ch"))
        .filter("ch <> ''")
        .groupBy("lang", "ch")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
        .filter(F.col("words") >= LETTER_WORDS)
    )
    letters: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for row in chars.select("lang", "ch", "n").collect():  # signs of Unicode at most, for each language
        if forms.is_letter(row.ch):
            letters[row.lang].append((row.ch, row.n))
    out = {}
    for row in totals.collect():
        by_script: Counter[str] = Counter()
        for ch, n in letters[row.lang]:
            if forms.script(ch):
                by_script[forms.script(ch)] += n
        script = "LATIN" if 2 * row.ascii >= row.total or not by_script else min(by_script, key=lambda s: (-by_script[s], s))
        own = sorted(ch for ch, _ in letters[row.lang] if forms.script(ch) in (script, None))
        out[row.lang] = (script, "".join(own))
    return out


def _residue(text: Column) -> Column:
    return F.call_function("translate", F.lower(text), F.col("letters"), F.lit(""))


def _unstable(text: Column) -> Column:
    """Whether NFC may change a text of usual letters: it joins or orders marks, and has letters for three signs."""
    joined = F.col("marks") & text.rlike(forms.COMPOSABLE)
    # Kelvin, angstrom and ohm are letters in lower case
    return joined | text.contains("K") | text.contains("Å") | text.contains("Ω")


def unusual(text: Column, capitals: bool = False) -> Column:
    """Whether a text next to (letters, latin, cased, marks) has signs beyond its language's letters and ASCII.

    In lists of other scripts ASCII letters are unusual too, and usual marks are unusual after a sign
    that they compose with. ``capitals``: capital letters count as
    unusual in languages where a wrong encoding can show letters as other letters in capitals.
    """
    # one expression, so that the letters are taken out once per row
    marked = F.concat(F.when(F.col("latin"), "L").otherwise("N"), _residue(text))
    odd = marked.rlike(r"(?s)[^\x00-\x7F«»]|\AN.*[a-z]") | _unstable(text)
    odd = odd | (F.col("cased") & (F.lower(text) != text)) if capitals else odd
    # bytes and signs are as many in ASCII text
    return F.when(F.col("latin") & (F.octet_length(text) == F.length(text)), F.lit(False)).otherwise(odd)


def _plain(word: Column) -> Column:
    """Whether a word next to (letters, latin, marks) is in lower case and holds letters of its language only."""
    rest = F.when(F.col("latin"), F.regexp_replace(_residue(word), "[a-z]", "")).otherwise(_residue(word))
    plain = (F.lower(word) == word) & (rest == "") & (word != "") & ~_unstable(word)
    # bytes and signs are as many in ASCII text
    return F.when(F.col("latin") & (F.octet_length(word) == F.length(word)), word.rlike(r"\A[a-z]+\z")).otherwise(plain)


def clean_words(vocab: DataFrame, frame: DataFrame) -> DataFrame:
    """(lang, word): words in lower case that hold letters of their language only."""
    # one row per language
    return vocab.join(F.broadcast(frame), "lang").filter(_plain(F.col("word"))).select("lang", "word")


#: Different letter pairs that a task counts before it hands them on.
PAIRS_KEPT = 500_000


def letter_pairs(words: DataFrame) -> DataFrame:
    """(lang, pair, n) of (lang, word): letter pairs, by places; ^ and $ are the ends."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter[tuple[str, int]] = Counter()

        def rows() -> pa.RecordBatch:
            columns = [code for code, _ in kept], [chr(both >> 21) + chr(both & 0x1FFFFF) for _, both in kept], list(kept.values())
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "pair", "n"])

        for batch in batches:
            codes = batch.column("lang").dictionary_encode()
            texts = pc.binary_join_element_wise("^", batch.column("word"), "$", "")
            sizes = pc.utf8_length(texts).to_numpy()
            signs = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
            inner = np.ones(len(signs), bool)  # the last sign of a word begins no pair
            inner[np.cumsum(sizes) - 1] = False
            at = np.flatnonzero(inner)
            lang = np.repeat(codes.indices.to_numpy().astype(np.int64), sizes)  # fewer than 2 ** 21 in a batch
            both, n = np.unique(lang[at] << 42 | signs[at] << 21 | signs[at + 1], return_counts=True)
            names = codes.dictionary.to_pylist()
            for key, places in zip(both.tolist(), n.tolist(), strict=True):
                kept[names[key >> 42], key & (1 << 42) - 1] += places
            if len(kept) >= PAIRS_KEPT:
                yield rows()
        yield rows()

    counts = words.select("lang", "word").mapInArrow(counted, "lang string, pair string, n bigint")
    return counts.groupBy("lang", "pair").agg(F.sum("n").alias("n"))


def study_pairs(clean: DataFrame) -> dict[str, tuple[dict[int, int], dict[str, int]]]:
    """code -> (bucket of letter pair -> places of clean words, first letter -> places); ^ and $ are the ends."""
    bucket = F.pmod(F.crc32(F.encode("pair", "UTF-8")), F.lit(forms.BUCKETS)).cast("int")
    counted = letter_pairs(clean)
    keyed = counted.select("lang", "n", bucket.alias("bucket"), F.substring("pair", 1, 1).alias("first"))
    both = keyed.groupingSets([["lang", "bucket"], ["lang", "first"]], "lang", "bucket", "first").agg(F.sum("n").alias("n"))
    out: dict[str, tuple[dict[int, int], dict[str, int]]] = defaultdict(lambda: ({}, {}))
    for row in both.collect():  # at most BUCKETS and the letters of each language
        if row.first is None:
            out[row.lang][0][row.bucket] = row.n
        else:
            out[row.lang][1][row.first] = row.n
    return dict(out)


class _Repairs(dict):
    """code -> (language, repair), built when a task first meets the language."""

    def __init__(self, study: Study) -> None:
        super().__init__()
        self.study, self.letters = study, study.foreign()

    def __missing__(self, code: str) -> tuple[forms.Language, forms.Repair]:
        lang = forms.Language(code, *self.study.languages[code])
        self[code] = lang, forms.Repair(lang, self.letters, self.study.kept(code), self.study.strange)
        return self[code]


_built: dict[tuple, _Repairs] = {}


def _repairs(study: Study) -> _Repairs:
    """The repairs of a study; a Python worker keeps those of its last one for its next task."""
    key = (study.chains, study.strange, tuple(sorted(study.local.items())), tuple(sorted(study.languages.items())))
    if key not in _built:
        _built.clear()
        _built[key] = _Repairs(study)
    return _built[key]


# ---------------------------------------------------------------- twins


#: Two ASCII letters with anything but the end of a line between them.
_LETTERS = re.compile("[A-Za-z][^\n\r\x85\u2028\u2029]*[A-Za-z]")
_NON_ASCII = re.compile("[^\x00-\x7f]+")
#: Words with one of these have no pattern.
_NO_PATTERN = re.compile("[\x00-\x7f\ufffd]")


def _cut(word: str, width: int) -> str | list[str]:
    """The units of a word."""
    return word if width == 1 else [word[i : i + width] for i in range(0, len(word), width)]


def twin_keys(vocab: DataFrame, frame: DataFrame) -> DataFrame:
    """(lang, word, n, clean, key, units, width): what a word may share with a twin, and its stretches beside that.

    width: of the units of a pattern, which are not listed, else 0. A word with ASCII letters has its text without other signs as the key. A word without ASCII signs
    has for each width the pattern in which its units repeat; clean words have units of one sign.
    """
    word = F.col("word")
    # one row per language
    marked = vocab.filter(F.octet_length(word) != F.length(word)).join(F.broadcast(frame), "lang").withColumn("clean", _plain(word))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [str(i) for i in range(1, 1000)]
        for batch in batches:
            at, keys, units, widths = [], [], [], []
            for i, (text, clean, latin) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("word", "clean", "latin")), strict=True)):
                if latin:
                    if _LETTERS.search(text):
                        at.append(i)
                        keys.append(_NON_ASCII.sub(GAP, text.lower()))
                        units.append(_NON_ASCII.findall(text))
                        widths.append(0)
                elif not _NO_PATTERN.search(text):
                    size = len(text)
                    for width in WIDTHS:
                        if size >= 4 * width and (width == 1 or not clean and size % width == 0):
                            parts = _cut(text, width)
                            at.append(i)
                            keys.append(",".join([places[n] if (n := parts.index(u)) < 999 else str(n + 1) for u in parts]))
                            units.append(None)
                            widths.append(width)
            rows = batch.select(["lang", "word", "n", "clean"]).take(pa.array(at, pa.int64()))
            for name, values, kind in (("key", keys, pa.string()), ("units", units, pa.list_(pa.string())), ("width", widths, pa.int32())):
                rows = rows.append_column(name, pa.array(values, kind))
            yield rows

    schema = "lang string, word string, n bigint, clean boolean, key string, units array<string>, width int"
    return marked.select("lang", "word", "n", "clean", "latin").mapInArrow(keyed, schema)


def stripped_twins(keyed: DataFrame) -> DataFrame:
    """(lang, word, clean, wrong, right, may): words next to what all clean twins of the same stripped text have in place of their stretches.

    Of two clean words the rarer may be garbled. A text and what fills its gaps are the word, so a
    text has no more twins than there are ways to fill its gaps.
    """
    keyed = keyed.filter("width = 0")
    twins = keyed.filter("clean").select("lang", "key", F.col("units").alias("right"), F.col("n").alias("twin_n"))
    pairs = keyed.join(twins, ["lang", "key"]).filter(~F.col("clean") | (F.col("twin_n") > F.col("n"))).filter(F.col("units") != F.col("right"))
    return pairs.select("lang", "word", "clean", F.col("units").alias("wrong"), "right", F.lit(None).cast("array<string>").alias("may"))


def pattern_twins(keyed: DataFrame, found: Study) -> DataFrame:
    """As ``stripped_twins``, for words without ASCII letters; may: the pairs of encodings that count.

    A pattern may be that of most words of a language, so its twins are not paired: for each pair of
    encodings the text that it may have made the word of is looked up among all clean words. Texts
    with letter pairs that no clean word has are none of them. In a large vocabulary some other text
    is a word by chance, so a pair of encodings counts if enough of its texts are words.
    """
    whole = keyed.filter("width > 0")
    twins = whole.filter("clean").select("lang", F.col("word").alias("text"), F.col("n").alias("twin_n"))
    legible: dict[str, set[str]] = defaultdict(set)
    for row in letter_pairs(whole.filter("clean")).select("lang", "pair").collect():  # pairs of letters of each language
        legible[row.lang].add(row.pair)
    scripts, letters = ({code: pair[i] for code, pair in found.languages.items()} for i in (0, 1))

    def undone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[str, forms.Originals] = {}
        for batch in batches:
            words: dict[str, list[int]] = defaultdict(list)  # of each language
            columns = [batch.column(c).to_pylist() for c in ("lang", "word", "width")]
            for i, code in enumerate(columns[0]):
                words[code].append(i)
            at, texts, chains = [], [], []
            for code, own in words.items():
                if code not in ways:
                    ways[code] = forms.Originals(letters[code], scripts[code], frozenset(legible.get(code, ())))
                which, made, names = ways[code].of_all([_cut(columns[1][i], columns[2][i]) for i in own])
                at += [own[i] for i in which]
                texts += made
                chains += names
            rows = batch.take(pa.array(at, pa.int64()))
            yield rows.append_column("text", pa.array(texts, pa.string())).append_column("chains", pa.array(chains, pa.string()))

    schema = "lang string, word string, n bigint, clean boolean, width int, text string, chains string"
    texts = whole.select("lang", "word", "n", "clean", "width").mapInArrow(undone, schema)
    rarer = ~F.col("clean") | (F.col("twin_n") > F.col("n"))
    met = stored(texts.join(twins, ["lang", "text"], "left").withColumn("twin", F.col("twin_n").isNotNull() & rarer))
    chains = F.split("chains", r"\|")
    counted = met.groupBy("lang", "clean", "chains").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("twin").cast("bigint")).alias("twins"))
    counted = counted.select("lang", "clean", "texts", "twins", F.explode(chains).alias("chain")).groupBy("lang", "clean", "chain")
    telling = counted.agg(F.sum("texts").alias("texts"), F.sum("twins").alias("twins")).filter(F.col("twins") >= WORD_SHARE * F.col("texts"))
    # one row per language
    may = telling.groupBy("lang", "clean").agg(F.collect_set("chain").alias("may"))
    units = lambda width: F.regexp_extract_all("word", F.lit(rf"(?s)(.{{{width}}})"), F.lit(1))
    wrong = F.when(F.col("width") == 1, F.split("word", "")).when(F.col("width") == 2, units(2)).otherwise(units(3))
    pairs = met.filter("twin").join(F.broadcast(may), ["lang", "clean"]).filter(F.arrays_overlap(chains, "may"))
    return pairs.select("lang", "word", "clean", wrong.alias("wrong"), F.split("text", "").alias("right"), "may")


#: Different signs by place of a pattern that a task collects before it hands them on.
PLACES_KEPT = 200_000


def open_votes(keyed: DataFrame, frame: DataFrame) -> DataFrame:
    """(lang, u, v, parts): what signs that are no letters may stand for by all twins of the same pattern, whatever encodings make.

    Twins with many letters at the place of a sign tell little about it: a word's vote counts 1 / letters
    and is split between them. Letters are counted for each place of a pattern, so no pairs are made, and in
    each task before they are handed on.
    """
    whole = keyed.filter(~F.col("key").contains(GAP)).select("lang", "word", "clean", "key")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str, int, dict[str, int]]]]:
        """Language, pattern, place and the units there with their words; a pattern may come again."""
        kept: dict[tuple[str, str], list[dict[str, int]]] = {}
        size = 0
        for batch in batches:
            for code, word, key in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "key")), strict=True):
                different = dict.fromkeys(_cut(word, len(word) // (key.count(",") + 1)))
                places = kept.get((code, key))
                if places is None:
                    places = kept[code, key] = [{} for _ in different]
                for counts, u in zip(places, different, strict=True):
                    if u in counts:
                        counts[u] += 1
                    else:
                        counts[u] = 1
                        size += 1
            if size >= PLACES_KEPT:
                yield [(*of, i, counts) for of, places in kept.items() for i, counts in enumerate(places)]
                kept.clear()
                size = 0
        yield [(*of, i, counts) for of, places in kept.items() for i, counts in enumerate(places)]

    def letters_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in placed(batches):
            langs, keys, at, counts = zip(*rows, strict=True) if rows else ((),) * 4
            columns = ((langs, pa.string()), (keys, pa.string()), (at, pa.int32()), ([list(c) for c in counts], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["lang", "key", "at", "vs"])

    def units_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in placed(batches):
            split = [(code, key, i, u, n) for code, key, i, counts in rows for u, n in counts.items()]
            columns = zip(*split, strict=True) if split else ((),) * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "key", "at", "u", "words"])

    words = whole.filter(~F.col("clean")).mapInArrow(units_at, "lang string, key string, at int, u string, words bigint")
    # one row per language
    words = words.join(F.broadcast(frame), "lang").filter(_residue(F.col("u")) != "")
    words = words.groupBy("lang", "key", "at", "u").agg(F.sum("words").alias("words"))
    letters = whole.filter("clean").mapInArrow(letters_at, "lang string, key string, at int, vs array<string>")
    letters = letters.groupBy("lang", "key", "at").agg(F.array_distinct(F.flatten(F.collect_list("vs"))).alias("vs"))  # letters of a language, from each task at most
    share = F.floor(F.col("words") * PARTS / F.size("vs") / F.size("vs"))
    split = words.join(letters, ["lang", "key", "at"]).select("lang", "u", share.alias("parts"), F.explode("vs").alias("v"))
    return split.groupBy("lang", "u", "v").agg(F.sum("parts").alias("parts"))


def substitutions(aligned: DataFrame, found: Study) -> DataFrame:
    """(lang, word, u, v, chains): what stands for what in each aligned word, and the pairs of encodings that make all of it.

    Stretches that stand for several letters are split evenly; invisible signs are no part of a stretch.
    """
    scripts = {code: script for code, (script, _) in found.languages.items()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[str]] = {}  # chains by script and substitutions
        for batch in batches:
            at, us, vs, chains, sizes = [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("lang", "clean", "wrong", "right", "may"))
            for i, (code, clean, wrong, right, may) in enumerate(zip(*columns, strict=True)):
                pairs = forms.substituted(wrong, right)
                if not pairs:
                    continue
                key = scripts[code], *pairs
                names = known.get(key)
                if names is None:
                    if len(known) >= 100_000:
                        known.clear()
                    names = known[key] = forms.common_chains(pairs, scripts[code])
                names = names if may is None else [name for name in names if name in may]
                # clean words without ASCII letters that repeat like their twin do so by chance
                if names or not clean or scripts[code] == "LATIN":
                    for u, v in pairs:
                        at.append(i)
                        us.append(u)
                        vs.append(v)
                        chains.append(names)
                        sizes.append(len(pairs))
            rows = batch.select(["lang", "word"]).take(pa.array(at, pa.int64()))
            for name, values, kind in (("u", us, pa.string()), ("v", vs, pa.string()), ("chains", chains, pa.list_(pa.string())), ("size", sizes, pa.int32())):
                rows = rows.append_column(name, pa.array(values, kind))
            yield rows

    return aligned.mapInArrow(split, "lang string, word string, u string, v string, chains array<string>, size int")


def learn(vocab: DataFrame, frame: DataFrame, found: Study) -> None:
    """Puts the substitutions and transformations that twins show into the study."""
    keyed = stored(twin_keys(vocab, frame))
    shown = stored(substitutions(stripped_twins(keyed).unionByName(pattern_twins(keyed, found)), found))
    # three letters of a word, or one stretch that is no letter, do not agree on a pair of encodings by chance
    named = (F.size("chains") > 0) & ((F.col("size") >= 3) | F.col("u").rlike(r"[^\p{L}]|(?s)..."))
    # pieces of stretches that a twin of other letters splits in the wrong place are no substitutions
    alone = (F.col("size") == 1) | ~F.col("word").rlike(r"[\x00-\x7F]")
    counted = (
        shown.groupBy("lang", "u", "v", "word")
        .agg(F.max(named.cast("bigint")).alias("named"), F.max(alone.cast("bigint")).alias("alone"))
        .select("lang", "u", "v", F.lit(PARTS).cast("bigint").alias("n"), "named", (F.col("alone") * PARTS).alias("alone"))
    )
    votes = open_votes(keyed, frame).select("lang", "u", "v", F.col("parts").alias("n"), F.lit(0).cast("bigint").alias("named"), F.col("parts").alias("alone"))
    counted = (
        counted.unionByName(votes)
        .groupBy("lang", "u", "v")
        .agg((F.sum("n") / PARTS).alias("n"), F.sum("named").alias("named"), (F.sum("alone") / PARTS).alias("alone"))
        .withColumn("of_lang", F.sum("n").over(Window.partitionBy("lang", "u")))
        .withColumn("pooled", F.sum("n").over(Window.partitionBy("u", "v")))
        .withColumn("of_all", F.sum("n").over(Window.partitionBy("u")))
        .withColumn("alone", F.sum("alone").over(Window.partitionBy("u", "v")))
        .withColumn("named_pooled", F.sum("named").over(Window.partitionBy("u", "v")))
        .filter(F.col("pooled") >= LEAST_WORDS)
    )
    rows = counted.collect()  # letters by the stretches that stand for them in several words
    script_of = {code: script for code, (script, _) in found.languages.items()}
    own = {(row.lang, row.u): all(forms.script(ch) == script_of[row.lang] for ch in row.u) for row in rows}
    seen = {(row.lang, row.u, row.v): row.n for row in rows}
    best: Counter[tuple[str, str]] = Counter()  # the most words that one letter has for a stretch
    of_named: Counter[tuple[str, str]] = Counter()
    right: Counter[tuple[str, str]] = Counter()
    wrong: Counter[tuple[str, str]] = Counter()
    for row in rows:
        best[row.lang, row.u] = max(best[row.lang, row.u], row.n)
        of_named[row.lang, row.u] += row.n if forms.chains_of(row.u, row.v, script_of[row.lang]) else 0
        right[row.lang, row.v] += row.named
    # words in which stretches of other signs stand for a letter before all
    support: Counter[tuple[str, str]] = Counter()
    for row in rows:
        if not own[row.lang, row.u] and row.n == best[row.lang, row.u] and forms.chains_of(row.u, row.v, script_of[row.lang]):
            support[row.lang, row.v] += row.n
    learned: set[tuple[str, str]] = set()
    strange: set[tuple[str, str]] = set()
    for row in rows:
        script, latin = script_of[row.lang], script_of[row.lang] == "LATIN"
        if latin and own[row.lang, row.u] and len(row.u) == 1:
            rival = seen.get((row.lang, row.v, row.u), 0)
            if row.n <= max(rival, support[row.lang, row.u.lower()]) or row.n < LETTER_SHARE * of_named[row.lang, row.u]:
                continue  # another letter of the language
        usual = row.n >= LEAST_WORDS and row.n >= UNIT_SHARE * row.of_lang or not own[row.lang, row.u] and row.pooled >= LEAST_WORDS and row.pooled >= UNIT_SHARE * row.of_all
        if forms.chains_of(row.u, row.v, script):
            if row.named >= LEAST_WORDS or not own[row.lang, row.u] and row.named_pooled >= LEAST_WORDS or usual and (latin or len(row.u) > 1):
                learned.add((row.u, row.v))
                for ch in set(row.u.lower() if latin else row.u) if own[row.lang, row.u] else ():
                    wrong[row.lang, ch] = wrong[row.lang, ch] + row.n if latin else max(wrong[row.lang, ch], row.named)
        elif row.alone >= UNNAMED_WORDS and row.alone >= UNNAMED_SHARE * row.of_all and not forms.looks_so(row.u, script):
            strange.add((row.u, row.v))
    pairs = vocab.sparkSession.createDataFrame(sorted(learned), "u string, v string")
    # letters by the stretches that stand for them
    known = shown.filter(F.size("chains") > 0).join(F.broadcast(pairs.withColumn("known", F.lit(True))), ["u", "v"], "left")
    agreed = known.groupBy("lang", "word", "chains").agg(F.bool_and(F.col("known").isNotNull() | (F.col("size") >= 3)).alias("all")).filter("all")
    pooled: Counter[tuple[str, ...]] = Counter()
    by_lang: dict[str, dict[tuple[str, ...], int]] = defaultdict(dict)
    for row in agreed.groupBy("lang", "chains").agg(F.count(F.lit(1)).alias("n")).collect():  # sets of pairs of encodings
        pooled[tuple(row.chains)] += row.n
        by_lang[row.lang][tuple(row.chains)] = row.n
    found.chains, found.local = fewest_chains(pooled), {code: fewest_chains(own, 0) for code, own in by_lang.items()}
    if strange:
        found.chains |= {forms.UNNAMED}
    found.strange = frozenset(strange)
    found.capitals = frozenset(code for code, (script, letters) in found.languages.items() if script != "LATIN" and any(forms.shown_in_script(c, letters, script) for c in found.kept(code)))
    for code, (script, letters) in found.languages.items():
        # a sign that more often stands for a letter than stretches stand for it is none
        backed = support if script == "LATIN" else right
        found.languages[code] = script, "".join(ch for ch in letters if wrong[code, ch] <= backed[code, ch])


def fewest_chains(sets: dict[tuple[str, ...], int], share: float | None = None) -> frozenset[str]:
    """A small set of chains that explains the words: again and again the one that explains most of the rest."""
    rank = {chain: i for i, chain in enumerate(dict.fromkeys(c for s in forms.WRITTEN for c in forms.chains(s)))}
    least = max(LEAST_WORDS, (LEAST_SHARE if share is None else share) * sum(sets.values()))
    kept, left = set(), dict(sets)
    while left:
        gain: Counter[str] = Counter()
        for chains, n in left.items():
            for chain in chains:
                gain[chain] += n
        best = min(gain, key=lambda c: (-gain[c], rank.get(c, len(rank)), c))
        if gain[best] < least:
            break
        kept.add(best)
        left = {chains: n for chains, n in left.items() if best not in chains}
    return frozenset(kept)


def study(raw_freq: DataFrame) -> tuple[Study, DataFrame, DataFrame]:
    """Letters, letter pairs and transformations of the languages of a table; its vocabulary and clean words."""
    vocab = vocabulary(raw_freq)
    found = Study(study_letters(vocab))
    learn(vocab, found.frame(vocab), found)
    clean = stored(clean_words(vocab, found.frame(vocab)))
    found.pairs = study_pairs(clean)
    return found, vocab, clean


# ---------------------------------------------------------------- verdicts

#: How much more usual a repaired word must be than the word as it stands: where the vocabulary
#: holds both, and where it holds neither.
GAIN_BOTH, GAIN_NEITHER = 1.0, 0.4


def word_verdicts(words: DataFrame, found: Study, clean: DataFrame | None = None) -> DataFrame:
    """``words`` (lang, word), each once, plus (kind, fixed, mapping): kind is 'garbled', 'disguised' or null.

    ``fixed`` is the original or the plain spelling; null where it can't be had. ``mapping`` names the
    transformation of a garbled word. Words that are legible both as they stand and repaired are
    looked up in ``clean``, the vocabulary's clean words. Without ``clean`` wrong decodings are not
    looked for.
    """
    languages, garbled = found.languages, clean is not None

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, foreign = _repairs(found), found.foreign()
        pairs = forms.Pairs.from_buckets(found.pairs, {code: script for code, (script, _) in languages.items()})

        def verdict(code: str, word: str) -> tuple:
            if code not in languages:
                return None, None, None, None, None
            lang, repair = tables[code]
            rival, gain, name = None, None, None
            if garbled:
                wrong, rival, gain, name = forms.judge(word, lang, foreign, repair, pairs)
                if wrong:
                    return "garbled", rival, name, None, None
            plain, other = forms.plain_form(word, lang, foreign)
            if plain != other and pairs.score(other, lang, foreign=True) >= pairs.score(plain, lang, foreign=True):
                plain = other
            return ("disguised" if plain != word else None), plain, name, rival, gain

        for batch in batches:
            out = [verdict(*key) for key in zip(batch["lang"], batch["word"], strict=True)]
            columns = zip(*out, strict=True) if out else ((),) * 5
            new = dict(zip(("kind", "fixed", "mapping", "rival", "gain"), columns, strict=True))
            yield batch.assign(**{k: pd.Series(v, dtype=float if k == "gain" else object, index=batch.index) for k, v in new.items()})

    schema = "lang string, word string, kind string, fixed string, mapping string"
    judgements = words.select("lang", "word").mapInPandas(judged, f"{schema}, rival string, gain double")
    columns = ["lang", "word", "kind", "fixed", "mapping"]
    if clean is None:
        return judgements.select(columns)
    judgements = stored(judgements)
    letters = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{M}]", ""))
    opened = judgements.filter(F.col("rival").isNotNull()).withColumn("as_is", letters("fixed")).withColumn("undone", letters("rival"))
    for key in ("as_is", "undone"):
        opened = opened.join(clean.select("lang", F.col("word").alias(key), F.lit(True).alias(f"knows_{key}")), ["lang", key], "left")
    own, other = F.col("knows_as_is").isNotNull(), F.col("knows_undone").isNotNull()
    wrong = (other & ~own) | (other & own & (F.col("gain") > GAIN_BOTH)) | (~other & ~own & (F.col("gain") > GAIN_NEITHER))
    decided = opened.select(
        "lang", "word", F.when(wrong, "garbled").otherwise(F.col("kind")).alias("kind"), F.when(wrong, F.col("rival")).otherwise(F.col("fixed")).alias("fixed"), "mapping"
    )
    return judgements.filter(F.col("rival").isNull()).select(columns).unionByName(decided)


def with_verdicts(rows: DataFrame, verdicts: DataFrame, text: str = "word") -> DataFrame:
    """``rows`` (with lang and ``text``) plus (kind, fixed, mapping); rows of words without a verdict stay."""
    return rows.join(verdicts.withColumnRenamed("word", text), ["lang", text], "left")


def split_usual(rows: DataFrame, frame: DataFrame, text: str = "word", capitals: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is plainly usual, the others); both with lang."""
    # one row per language
    joined = rows.join(F.broadcast(frame), "lang", "left")
    odd = F.coalesce(unusual(F.col(text), capitals), F.lit(False))
    return tuple(joined.filter(part).drop("letters", "latin", "cased", "marks") for part in (~odd, odd))


def judged_words(raw_freq: DataFrame) -> tuple[Study, DataFrame, DataFrame]:
    """(study, (lang, letters, ...) of each language, verdicts on the distinct odd words of a table)."""
    found, vocab, clean = study(raw_freq)
    frame = found.frame(raw_freq)
    return found, frame, word_verdicts(split_usual(vocab, frame)[1], found, clean)


def repaired_rows(raw_freq: DataFrame) -> DataFrame:
    """(row_id, lang, word, original, mapping) of every row whose word shows wrong characters."""
    _, frame, verdicts = judged_words(raw_freq)
    rows = raw_freq.filter(F.col("word").isNotNull() & F.col("file").isNotNull()).select("row_id", lang_of().alias("lang"), "word")
    odd = split_usual(rows, frame)[1]
    wrong = verdicts.filter("kind = 'garbled'")
    return odd.join(wrong, ["lang", "word"]).select("row_id", "lang", "word", F.col("fixed").alias("original"), "mapping")
