"""Problem 3: names typed by hand mapped to a list of canonical names; the rest is reported.

Method. One automaton holds all canonical names, their derived forms (as adjectives) and the words of
area or age with their abbreviations. It runs over the folded text (case, accents, signs and digits in
place of letters); the longest matches that do not overlap win. A name and an area or age word stand
for the entry with that word. What is left over of a value must be words that say nothing (a fixed
list); values with other words left go to token-set similarity: entries that share letter pairs with
the value's words are candidates, each word is compared with the entry's words by edits, and the
nearest entry is taken if it is near enough. Each distinct value is matched once. Further names of
entries may be given as a table.

Edge cases: null, empty and filler values stand for nothing; repeated rows are matched each; ties of
similarity are decided by the entry's code, then by its order in the list; very long values are
searched whole by the automaton, and are too far from every name to be similar; an empty list or
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the list that are sent to every task; a longer list is an error.
MOST_ENTRIES = 100_000
# Words beside a name that say nothing about the language.
NOISE = frozenset("the language lang corpus corpora dialect dialects spoken written speech text texts sic ud treebank list data file of in".split())
# Endings of adjectives made of a name.
ENDINGS = ("ish", "ese", "ian", "ean", "ic", "an", "i")
# Other words for an area or age word, and short forms that are not its beginning.
OTHER_WORDS = {"ancient": "old", "anc": "old", "nth": "northern", "sth": "southern", "hl": "highland", "isl": "island"}
_DIGITS = str.maketrans("01345", "oleas")
_DIGITS_I = str.maketrans("01345", "oieas")


def fold(text: str) -> str:
    """Lower case without accents; signs other than full stops become blanks."""
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(ch))
    return " ".join(re.sub(r"[^\w.]+|_", " ", plain).split())


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours from a to b; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [i] + [0] * len(b)
        low = i
        for j, y in enumerate(b, 1):
            cost = before[j - 1] + (x != y)
            if before[j] + 1 < cost:
                cost = before[j] + 1
            if row[j - 1] + 1 < cost:
                cost = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and two[j - 2] + 1 < cost:
                cost = two[j - 2] + 1
            row[j] = cost
            if cost < low:
                low = cost
        if low > most:
            return most + 1
    return min(row[-1], most + 1)


def near_enough(size: int) -> int:
    """How many edits a name of so many letters may be away."""
    return 1 if size < 6 else 2 if size < 9 else 3


class Names:
    """The canonical list, prepared for matching."""

    def __init__(self, entries: list[tuple[str, str]], aliases: list[tuple[str, str]] = ()) -> None:
        """``entries``: (code, name); ``aliases``: (code, other name) of entries of the list."""
        folded = [(code, fold(name)) for code, name in entries if code and name and fold(name)]
        known = {name for _, name in folded}
        # words of area or age: those that, before or after a listed name, make another listed name
        first, last = Counter(), Counter()
        for _, name in folded:
            head, _, tail = name.partition(" ")
            if tail in known:
                first[head] += 1
            head, _, tail = name.rpartition(" ")
            if head in known:
                last[tail] += 1
        self.areas = [*sorted(first), *sorted(set(last) - set(first))]
        areas = set(self.areas)
        self.by_base: dict[tuple[str, str], str] = {}
        self.bases: dict[str, tuple[str, ...]] = {}
        for code, name in folded:
            words = name.split()
            area = ""
            if len(words) > 1 and words[0] in areas:
                area, words = words[0], words[1:]
            elif len(words) > 1 and words[-1] in areas:
                area, words = words[-1], words[:-1]
            base = " ".join(words)
            self.by_base.setdefault((base, area), code)
            self.bases.setdefault(base, tuple(words))
        self.forms: dict[str, str] = {}
        for base in self.bases:
            self.forms[base] = base
        for base in self.bases:
            for stem in (base, base.rstrip("aeiou")):
                for ending in ENDINGS:
                    if len(stem) >= 3:
                        self.forms.setdefault(stem + ending, base)
        base_of = {code: base for (base, area), code in reversed(self.by_base.items()) if not area}
        for code, alias in aliases:
            if code in base_of and alias and fold(alias):
                self.forms.setdefault(fold(alias), base_of[code])
        self.longest = max(map(len, self.forms), default=0)
        self.automaton = ahocorasick.Automaton()
        for form, base in self.forms.items():
            self.automaton.add_word(f" {form} ", ("name", base, len(form) + 2))
        for area in reversed(self.areas):
            for word in self._area_words(area):
                self.automaton.add_word(f" {word} ", ("area", area, len(word) + 2))
        if len(self.forms):
            self.automaton.make_automaton()
        self.pairs: dict[str, list[str]] = defaultdict(list)
        for form in self.forms:
            for pair in self._pairs(form):
                self.pairs[pair].append(form)
        # whole names run together, for values whose blanks are displaced or whose area word is misspelt
        self.whole: dict[str, str] = {}
        self.whole_pairs: dict[str, list[str]] = defaultdict(list)
        for (base, area), code in self.by_base.items():
            for words in ((area, base), (base, area)):
                self.whole.setdefault("".join(words).replace(" ", ""), code)
        self.longest_whole = max(map(len, self.whole), default=0)
        for name in self.whole:
            for pair in self._pairs(name):
                self.whole_pairs[pair].append(name)

    def _area_words(self, area: str) -> list[str]:
        words = {area, *(w for w, a in OTHER_WORDS.items() if a == area), *(f"{w}." for w, a in OTHER_WORDS.items() if a == area)}
        if area.endswith("ern"):
            words.add(area[:-3])
        words |= {f"{area[:i]}." for i in range(1, len(area))}
        return sorted(words)

    @staticmethod
    def _pairs(text: str) -> set[str]:
        text = f"^{text.replace(' ', '')}$"
        return {text[i : i + 2] for i in range(len(text) - 1)}

    def mentions(self, text: str) -> tuple[str | None, str, list[str]]:
        """(base, area, words left over): the longest matches that do not overlap."""
        spaced = f" {text.replace(' ', '  ')} "
        found = sorted((end - size + 1, end, kind, value) for end, (kind, value, size) in self.automaton.iter(spaced)) if self.forms else []
        # a form of several words was stored with single blanks
        if " " in text:
            single = f" {text} "
            for end, (kind, value, size) in self.automaton.iter(single) if self.forms else ():
                form = single[end - size + 2 : end]
                if " " in form:
                    start = single[: end - size + 1].count(" ") + end - size + 1
                    found.append((start, start + size - 1 + form.count(" "), kind, value))
        chosen: list[tuple[int, int, str, str]] = []
        for start, end, kind, value in sorted(found, key=lambda m: (m[0] - m[1], m[2] != "name", m[0])):
            if all(end < s or start > e for s, e, _, _ in chosen):
                chosen.append((start, end, kind, value))
        rest = list(spaced)
        for start, end, _, _ in chosen:
            rest[start : end + 1] = " " * (end + 1 - start)
        left = [w for w in "".join(rest).split() if w.strip(".") not in NOISE and not w.strip(".").isdigit() and w.strip(".")]
        bases = [v for _, _, k, v in chosen if k == "name"]
        areas = [v for _, _, k, v in chosen if k == "area"]
        return (bases[0] if len(bases) == 1 else None), (areas[0] if len(areas) == 1 else ""), left

    def similar(self, words: list[str], area: str, code: str | None) -> tuple[int, str] | None:
        """(edits, entry) of the nearest entry by its words, if near enough; with ``area`` if one was found."""
        best: tuple | None = None
        for wanted, rest in [(area, words)] if area else self._splits(words):
            text = " ".join(rest)
            size = len(text.replace(" ", ""))
            most = near_enough(size)
            if size < 3 or len(text) > self.longest + most:  # longer than any name may be
                continue
            shared: Counter[str] = Counter()
            own = self._pairs(text)
            for pair in own:
                shared.update(self.pairs.get(pair, ()))
            for form, n in shared.items():
                # an edit changes at most three letter pairs of a text
                if n < len(own) - 3 * most - 1 or abs(len(form) - len(text)) > most:
                    continue
                base = self.forms[form]
                entry = self.by_base.get((base, wanted))
                if entry is None:
                    continue
                d = self._word_edits(text, form, most)
                if d <= most:
                    key = (d, form != base, entry != code, -n, entry)
                    best = key if best is None else min(best, key)
        return (best[0], best[-1]) if best else None

    @staticmethod
    def _word_edits(a: str, b: str, most: int) -> int:
        """Edits between two sets of words; the order of two words does not matter."""
        d = edits(a, b, most)
        if d > 1 and " " in a:
            d = min(d, edits(" ".join(sorted(a.split())), " ".join(sorted(b.split())), most))
        return d

    def _splits(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(area, other words): no area word, and each word that is nearly one."""
        found = False
        for i, word in enumerate(words):
            bare = word.strip(".")
            for area in self.areas:
                if len(bare) >= 3 and edits(bare, area, 2) <= (2 if len(area) > 6 else 1) and len(words) > 1:
                    found = True
                    yield area, words[:i] + words[i + 1 :]
        if not found:
            yield "", words

    def match(self, text: str | None, code: str | None = None) -> str | None:
        """The code of the entry that a typed name stands for, or None."""
        if not text:
            return None
        folded = fold(text)
        if not folded:
            return None
        for form in self._readings(folded):
            base, area, left = self.mentions(form)
            if base is not None and not left:
                hit = self.by_base.get((base, area))  # no entry with that word: not this name
                if hit is not None:
                    return hit
        best = None
        for form in self._readings(folded):
            _, area, _ = self.mentions(form)
            words = [w for w in self._without_areas(form, area) if w.strip(".") not in NOISE and not w.strip(".").isdigit()]
            words = [w.strip(".") for w in words if w.strip(".")]
            near = self.similar(words, area, code)
            if near is not None and (best is None or near[0] < best[0]):
                best = near
            if near is None and not area:
                near = self.similar_whole("".join(words).replace(".", ""), code)
                if near is not None and (best is None or near[0] < best[0]):
                    best = near
        return best[1] if best else None

    def similar_whole(self, text: str, code: str | None) -> tuple[int, str] | None:
        """(edits, entry) of the nearest whole name without its blanks."""
        most = near_enough(len(text))
        if len(text) < 6 or len(text) > self.longest_whole + most:
            return None
        own = self._pairs(text)
        shared: Counter[str] = Counter()
        for pair in own:
            shared.update(self.whole_pairs.get(pair, ()))
        best: tuple | None = None
        for name, n in shared.items():
            if n >= len(own) - 3 * most - 1 and (d := edits(text, name, most)) <= most:
                key = (d, self.whole[name] != code, self.whole[name])
                best = key if best is None else min(best, key)
        return (best[0], best[-1]) if best else None

    def _without_areas(self, text: str, area: str) -> list[str]:
        if not area:
            return text.split()
        drop = set(self._area_words(area))
        words = text.split()
        for i, w in enumerate(words):
            if w in drop:
                return words[:i] + words[i + 1 :]
        return words

    @staticmethod
    def _readings(folded: str) -> list[str]:
        """The text with digits inside words read as letters, and without a treebank's mark at its end."""
        out = []
        for digits in (_DIGITS, _DIGITS_I):
            words = [w.translate(digits) if re.search("[a-z]", w) else w for w in folded.split()]
            if words and words[0] == "ud" and len(words) > 2:
                out.append(" ".join(words[1:-1]))
            out.append(" ".join(words))
        return list(dict.fromkeys(out))


def read_names(languages: DataFrame) -> list[tuple[str, str]]:
    """(iso_code, name) of the list, ordered; an error if it is not a short list."""
    rows = languages.filter(F.col("iso_code").isNotNull() & F.col("name").isNotNull()).select("iso_code", "name").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the list has more than {MOST_ENTRIES} names")
    return sorted((r.iso_code, r.name) for r in rows)


def match_names(typed: DataFrame, languages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``typed`` (tbl, entry_id, code, name) plus iso_code, null where the name stands for no entry.

    ``aliases`` (iso_code, name): other names of the list's entries. Each distinct (name, code) is
    matched once and joined back.
    """
    entries = read_names(languages)
    others = read_names(aliases) if aliases is not None else []

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(entries, others)
        for batch in batches:
            codes = [names.match(*key) for key in zip(batch["name"], batch["code"], strict=True)]
            yield batch.assign(iso_code=pd.Series(codes, dtype=object, index=batch.index))

    typed = typed.select("tbl", "entry_id", "code", "name")
    # few bytes, but much work for each: an explicit number of tasks is not merged into one
    tasks = int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = typed.select("name", "code").repartition(tasks, "name", "code").distinct()
    known = distinct.mapInPandas(match, "name string, code string, iso_code string").alias("k")
    same = F.col("t.name").eqNullSafe(F.col("k.name")) & F.col("t.code").eqNullSafe(F.col("k.code"))
    return typed.alias("t").join(known, same, "left").select("t.tbl", "t.entry_id", "t.code", "t.name", "k.iso_code")


def typed_names(lepzig_shortcuts: DataFrame, ud_language_mapping: DataFrame) -> DataFrame:
    """(tbl, entry_id, code, name) of both tables."""
    one = lepzig_shortcuts.select(F.lit("lepzig_shortcuts").alias("tbl"), "entry_id", "code", F.col("language").alias("name"))
    two = ud_language_mapping.select(F.lit("ud_language_mapping").alias("tbl"), "entry_id", "code", F.col("ud_name").alias("name"))
    return one.unionByName(two)


def unmatched_names(matched: DataFrame) -> DataFrame:
    """(tbl, name, entries): the values that stand for no entry, with how often they were typed."""
    return matched.filter(F.col("iso_code").isNull()).groupBy("tbl", "name").agg(F.count(F.lit(1)).alias("entries"))
