"""Per-word helpers of problems 2 and 4: scripts, units of wrong decodings, plain spelling.

Everything here works on single words that Spark has already deduplicated and filtered down to
those with unusual characters; nothing here holds more than the letters of the languages.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import zlib
from collections.abc import Iterable, Sequence

import numpy as np
import regex

INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")

# Signs that stand for an ASCII sign.
SIGNS = {
    **dict.fromkeys("‐‑‒–—―−­﹘﹣˗⁃", "-"),
    **dict.fromkeys("‘’‚‛′‵ʹʻʼʽˈ´՚ꞌ", "'"),
    **dict.fromkeys("“”„‟″‶", '"'),
    "․": ".",
    "…": "...",
    "⁄": "/",
    "∕": "/",
    "∗": "*",
    "⁎": "*",
    "∶": ":",
    "꞉": ":",
    "\u037e": ";",
    "ǃ": "!",
    "➕": "+",
}

# Letters of other scripts that look like a Latin letter, and the way back.
_LOOKS_LATIN = {
    "CYRILLIC": dict(zip("аеорсухѕіјһԁԛԝАВЕКМНОРСТУХЅІЈ", "aeopcyxsijhdqwABEKMHOPCTYXSIJ", strict=True)),
    "GREEK": dict(zip("ονραιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpaiABEZHIKMNOPTYX", strict=True)),
}
_LATIN_LOOKS = {name: {latin: ch for ch, latin in pairs.items()} for name, pairs in _LOOKS_LATIN.items()}


@functools.lru_cache(maxsize=65536)
def script(ch: str) -> str | None:
    """The script of a letter by its Unicode name; None for marks, signs and digits."""
    if unicodedata.category(ch)[0] != "L":
        return None
    name = unicodedata.name(ch, "")
    if name.startswith(("FULLWIDTH LATIN", "MATHEMATICAL", "LATIN", "FEMININE", "MASCULINE", "SUPERSCRIPT LATIN", "MODIFIER")):
        return "LATIN"
    return name.split(" ", 1)[0]


def is_letter(ch: str) -> bool:
    """A letter or mark that is stable under normalisation."""
    return unicodedata.category(ch)[0] in "LM" and unicodedata.is_normalized("NFKC", ch) and not INVISIBLE.match(ch)


def look_alike(ch: str, to: str) -> str | None:
    """The letter of script ``to`` that looks like ``ch``; None if there is none."""
    own = script(ch)
    if own == to:
        return ch
    latin = ch if own == "LATIN" else _LOOKS_LATIN.get(own, {}).get(ch)
    if latin is None or to == "LATIN":
        return latin
    return _LATIN_LOOKS.get(to, {}).get(latin)


# ---------------------------------------------------------------- plain spelling (problem 4)


def _compat(ch: str) -> str:
    """One sign in its plain form; composed letters stay."""
    if ch in SIGNS:
        return SIGNS[ch]
    cat = unicodedata.category(ch)
    if cat == "Zs":
        return " "
    if cat in ("Pi", "Pf"):  # guillemets have no ASCII form
        return ch
    return unicodedata.normalize("NFKC", ch)


_RUN = regex.compile(r"[\p{L}\p{M}]+")


def _runs(word: str) -> list[tuple[int, int]]:
    """The runs of letters and marks of a word."""
    return [m.span() for m in _RUN.finditer(word)]


@functools.lru_cache(maxsize=65536)
def _needs_work(ch: str) -> bool:
    """The quick check: True for signs that are not stable by themselves."""
    if ch < "\x80":
        return False
    return (
        ch in SIGNS
        or INVISIBLE.match(ch) is not None
        or unicodedata.category(ch) in ("Mn", "Mc", "Zs")
        or not unicodedata.is_normalized("NFKC", ch)
    )


def compose(word: str) -> str:
    """Invisible signs dropped, variants of signs and letters made plain, letters composed.

    Only the segments that fail the quick check are normalised, each from the starter before it to
    the next starter after it, and spliced into the rest.
    """
    if not any(map(_needs_work, word)):
        return word
    out, i, n = [], 0, len(word)
    while i < n:
        j = i
        while j < n and not _needs_work(word[j]):
            j += 1
        if j == n:
            out.append(word[i:])
            break
        start = max(i, j - 1)  # the starter that a mark may join
        end = j
        while end < n and (_needs_work(word[end]) or unicodedata.combining(word[end])):
            end += 1
        end = min(n, end + 1) if end < n and unicodedata.category(word[end]) == "Lm" else end
        out.append(word[i:start])
        segment = INVISIBLE.sub("", word[start:end])
        out.append(unicodedata.normalize("NFC", "".join(map(_compat, segment))))
        i = end
    return unicodedata.normalize("NFC", "".join(out)) if len(out) > 2 else "".join(out)


def _composable() -> str:
    """Pattern of all texts that NFC changes by joining or ordering signs: two signs that compose, or marks in a row."""
    bases: dict[str, str] = {}
    for ch in map(chr, range(0x80, 0x20000)):
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.is_normalized("NFC", ch):
            base, mark = (chr(int(part, 16)) for part in parts)
            bases[mark] = bases.get(mark, "") + base
    marks: dict[str, str] = {}  # marks that compose with the same signs
    for mark, signs in bases.items():
        marks[signs] = marks.get(signs, "") + mark
    joined = "|".join(f"[{signs}][{after}]" for signs, after in marks.items())
    # the second sign first: most places of a text fail there
    return rf"[\p{{M}}\u1161-\u1175\u11a8-\u11c2](?<={joined}|\p{{M}}\p{{M}}|[\u1100-\u1112][\u1161-\u1175]|[\uac00-\ud7a3][\u11a8-\u11c2])"


COMPOSABLE = _composable()


class Language:
    """Script and usual letters of one language."""

    __slots__ = ("_own", "code", "letters", "script", "strays")

    def __init__(self, code: str, script_name: str, letters: str) -> None:
        self.code, self.script, self.letters = code, script_name, frozenset(letters)
        self.strays: dict[str, bool] = {}  # verdicts on signs
        self._own: set[str] = set()  # signs met so far that are of no other script

    def own_script(self, text: str) -> bool:
        """Whether no sign of a text is of another script."""
        if self._own.issuperset(text):
            return True
        if any(script(ch) not in (self.script, None) for ch in text):
            return False
        self._own.update(text)
        return True

    def has(self, ch: str) -> bool:
        """A usual letter of the language, in either case, or an ASCII letter in a Latin list."""
        if ch < "\x80":
            return self.script == "LATIN" or not ch.isalpha()
        return ch in self.letters or ch.lower() in self.letters


def plain_form(word: str, lang: Language, foreign: dict[str, frozenset[str]]) -> tuple[str, str]:
    """(plain spelling, spelling that may also be plain).

    Runs of letters that mix scripts are brought to one script. A run that is all of another script
    and looks like letters of the list's own may be disguised or a foreign word: the first result
    has it mapped, the second as it is. Both are equal where nothing is open. A word with another
    run that can only be foreign keeps such runs. ``foreign``: letters of all languages by script.
    """
    text = compose(word)
    if text.isascii() and lang.script == "LATIN":
        return text, text
    if lang.own_script(text):
        plain = unicodedata.normalize("NFC", text)
        return plain, plain
    runs, definite = [], False
    for start, end in _runs(text):
        run = text[start:end]
        scripts = {s for s in map(script, run) if s}
        mapped, open_run = run, False
        if scripts and scripts != {lang.script}:
            own = [look_alike(ch, lang.script) if script(ch) else ch for ch in run]
            if lang.script in scripts:
                mapped = "".join(m or ch for m, ch in zip(own, run, strict=True))
                if len({s for s in map(script, mapped) if s}) > 1:  # a foreign word with letters of the list's script
                    mapped = _to_one_script(run, scripts)
            elif len(scripts) > 1:
                mapped = _to_one_script(run, scripts)
                definite = True
            elif all(m and (lang.has(m) or not script(m)) for m in own):
                known = foreign.get(next(iter(scripts)), frozenset())
                mapped = "".join(own)
                open_run = all(ch.lower() in known or ch < "\x80" or not script(ch) for ch in run)
            else:
                definite = True
        runs.append((start, end, mapped, open_run))
    first, second, at = [], [], 0
    for start, end, mapped, open_run in runs:
        kept = text[start:end]
        first += [text[at:start], kept if open_run and definite else mapped]
        second += [text[at:start], kept if open_run else mapped]
        at = end
    tail = text[at:]
    return tuple(unicodedata.normalize("NFC", "".join((*parts, tail))) for parts in (first, second))


def _to_one_script(run: str, scripts: set[str]) -> str:
    """A run of several scripts in the one that most of it has, where that can be done letter by letter."""
    main = max(sorted(scripts), key=lambda s: sum(script(ch) == s for ch in run))
    return "".join((look_alike(ch, main) or ch) if script(ch) else ch for ch in run)


def one_script(word: str) -> bool:
    """True if no run of letters mixes scripts."""
    return all(len({s for s in map(script, word[a:b]) if s}) <= 1 for a, b in _runs(word))


#: Letter pairs are counted in so many buckets for each language, whatever its script.
BUCKETS = 1 << 18


def bucket(pair: str) -> int:
    return zlib.crc32(pair.encode()) % BUCKETS


class Pairs:
    """How usual the letter pairs of a word are in a language: mean log probability of a pair."""

    def __init__(self, counts: dict[str, dict[str, int]], script_of: dict[str, str]) -> None:
        """``counts``: code -> letter pair -> number of places."""
        both: dict[str, tuple[dict[int, int], dict[str, int]]] = {}
        for code, pairs in counts.items():
            buckets, first = both.setdefault(code, ({}, {}))
            for pair, n in pairs.items():
                buckets[bucket(pair)] = buckets.get(bucket(pair), 0) + n
                first[pair[0]] = first.get(pair[0], 0) + n
        self._set(both, script_of)

    @classmethod
    def from_buckets(cls, counts: dict[str, tuple[dict[int, int], dict[str, int]]], script_of: dict[str, str]) -> Pairs:
        """``counts``: code -> (bucket of a pair -> number of places, first letter -> number of places)."""
        self = cls.__new__(cls)
        self._set(counts, script_of)
        return self

    def _set(self, counts: dict[str, tuple[dict[int, int], dict[str, int]]], script_of: dict[str, str]) -> None:
        self.by_lang = counts
        self._known: dict[str, dict[str, float]] = {}  # values of the pairs met so far
        self.langs: dict[str, list[str]] = {}
        for code in counts:
            self.langs.setdefault(script_of.get(code, ""), []).append(code)

    def _value(self, pair: str, code: str) -> float:
        buckets, first = self.by_lang.get(code, ({}, {}))
        n = first.get(pair[0])
        return math.log((buckets.get(bucket(pair), 0) + 0.5) / (n + 0.5 * (len(first) + 2))) if n else -9.0

    def run_score(self, run: str, code: str) -> float:
        known = self._known.setdefault(code, {})
        text, total = f"^{run.lower()}$", 0.0
        for pair in map("".join, zip(text, text[1:])):
            value = known.get(pair)
            if value is None:
                if len(known) >= BUCKETS:
                    known.clear()
                value = known[pair] = self._value(pair, code)
            total += value
        return total / (len(text) - 1)

    def score(self, word: str, lang: Language, foreign: bool = False) -> float:
        """Mean over the runs of letters. ``foreign``: runs in another script count by their best language."""
        total, size = 0.0, 0
        for a, b in _runs(word):
            run = word[a:b]
            own = next((s for s in map(script, run) if s), lang.script)
            if own == lang.script or not foreign:
                value = self.run_score(run, lang.code)
            else:
                value = max((self.run_score(run, c) for c in self.langs.get(own, ())), default=-9.0)
            total, size = total + value * len(run), size + len(run)
        return total / size if size else -9.0


# ---------------------------------------------------------------- wrong decodings (problem 2)

#: Codecs a list may have been written in, by the script of its language, besides UTF-8.
WRITTEN = {
    "LATIN": ("cp1252", "cp1250", "cp1254", "cp1257", "iso8859-2", "iso8859-15", "cp1258", "mac_roman", "cp437", "cp850", "cp852"),
    "CYRILLIC": ("cp1251", "koi8-r", "koi8-u", "cp866", "iso8859-5", "mac_cyrillic", "cp855"),
    "GREEK": ("cp1253", "iso8859-7", "mac_greek", "cp737"),
}
#: Codecs it may have been read in.
READ = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8-r", "koi8-u", "iso8859-2", "iso8859-5", "iso8859-7", "mac_cyrillic")


def _read(data: bytes, codec: str) -> str:
    """Bytes as a reader shows them; a byte without a sign is shown as its C1 control."""
    try:
        return data.decode(codec)
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in data)


def garble(text: str, chain: str) -> str | None:
    """``text`` after a chain such as 'utf-8>cp1252'; None if it can't be written so."""
    try:
        for step in chain.split(" "):
            written, read = step.split(">")
            text = _read(text.encode(written), read)
    except UnicodeEncodeError:
        return None
    return text


@functools.lru_cache(maxsize=None)
def chains(script_name: str) -> tuple[str, ...]:
    """All chains that a list in this script may have gone through, simple ones first."""
    simple = [f"utf-8>{r}" for r in READ]
    single = [f"{w}>{r}" for w in WRITTEN.get(script_name, ()) for r in READ if r != w]
    double = [f"utf-8>{r} utf-8>{r}" for r in ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")]
    return (*simple, *single, *double)


#: The transformation of learned substitutions that no chain makes.
UNNAMED = "learned"


@functools.lru_cache(maxsize=None)
def _made_of(letter: str, script_name: str) -> dict[str, frozenset[str]]:
    """What a letter, in either case, is shown as -> the chains that show it so."""
    made: dict[str, set[str]] = {}
    for chain in chains(script_name):
        for form in dict.fromkeys((letter, letter.upper())):
            shown = garble(form, chain) if len(form) == 1 else None
            if shown:
                for unit in (shown, shown.lower()):
                    made.setdefault(unit, set()).add(chain)
    return {unit: frozenset(names) for unit, names in made.items()}


def chains_of(unit: str, letter: str, script_name: str) -> frozenset[str]:
    """The chains that show a letter as this unit."""
    return _made_of(letter, script_name).get(unit, frozenset())


def common_chains(pairs: list[tuple[str, str]], script_name: str) -> list[str]:
    """The chains that make all of the substitutions, in order."""
    common: frozenset[str] | None = None
    for unit, letter in pairs:
        names = chains_of(unit, letter, script_name)
        common = names if common is None else common & names
        if not common:
            return []
    return sorted(common or ())


#: Units (words by the longest of them) that are looked at together.
UNITS_AT_ONCE = 100_000


class Originals:
    """The texts of a language's letters that a chain shows as given units.

    ``legible``: the letter pairs (^ and $ are the ends) that a text may have. Sets of chains are bits in columns of 64.
    """

    def __init__(self, letters: str, script_name: str, legible: frozenset[str]) -> None:
        self._chains, own = chains(script_name), sorted(set(letters))
        self._codes = np.array([ord(ch) for ch in own], "<u4")
        at = {ch: i for i, ch in enumerate(own)} | {"^": len(own), "$": len(own)}
        self._legible = np.zeros((len(own) + 1, len(own) + 1), bool)
        for before, after in legible:
            if before in at and after in at:
                self._legible[at[before], at[after]] = True
        shown: dict[str, list[tuple[int, frozenset[str]]]] = {}  # unit -> (letter, the chains that show it so)
        for letter in own:
            for unit, names in _made_of(letter, script_name).items():
                shown.setdefault(unit, []).append((at[letter], names))
        self._ids = {unit: i for i, unit in enumerate(shown, 1)}  # 0: a unit that no chain makes
        options = [(i, *way) for i, ways in enumerate(shown.values(), 1) for way in ways]
        unit, letter = (np.array([way[i] for way in options], np.int64) for i in (0, 1))
        # chains that make the same of all letters share a bit
        makes: dict[str, list[int]] = {chain: [] for chain in self._chains}
        for i, (*_, names) in enumerate(options):
            for name in names:
                makes[name].append(i)
        alike: dict[tuple[int, ...], int] = {}
        self._bit = {chain: alike.setdefault(tuple(made), len(alike)) for chain, made in makes.items() if made}
        self._columns = max(1, -(-len(alike) // 64))
        also = np.zeros((self._columns, len(options)), np.uint64)
        for made, bit in alike.items():
            also[bit >> 6, list(made)] |= np.uint64(1 << (bit & 63))
        # by letter before and unit, the legible letters
        before, option = np.nonzero(self._legible[:, letter])
        self._letter, self._also = letter[option].astype(np.int16), also[:, option]
        of = before * (len(shown) + 1) + unit[option]
        self._many = np.bincount(of, minlength=(len(own) + 1) * (len(shown) + 1))
        self._first = np.cumsum(self._many) - self._many
        self._any = np.zeros((self._columns, len(shown) + 1), np.uint64)
        for column, bits in zip(self._any, also, strict=True):
            np.bitwise_or.at(column, unit, bits)
        self._names: dict[tuple[int, ...], str] = {}

    def of(self, units: Sequence[str]) -> dict[str, str]:
        """All other texts of one letter for each unit, different ones for different units -> the chains, with | between."""
        _, texts, names = self.of_all([units])
        return dict(zip(texts, names, strict=True))

    def of_all(self, words: Sequence[Sequence[str]]) -> tuple[list[int], list[str], list[str]]:
        """The number of a word, one of its texts as in ``of``, the chains."""
        out: tuple[list[int], list[str], list[str]] = [], [], []
        some: list[int] = []
        for i in sorted((i for i, word in enumerate(words) if len(word)), key=lambda i: len(words[i])):
            if some and (len(some) + 1) * len(words[i]) > UNITS_AT_ONCE:
                self._look_up(words, some, out)
                some = []
            some.append(i)
        if some:
            self._look_up(words, some, out)
        return out

    def _look_up(self, words: Sequence[Sequence[str]], some: list[int], out: tuple[list[int], list[str], list[str]]) -> None:
        """Adds the texts of some words: all of them grow by a letter at a time."""
        ids = [[self._ids.get(u, 0) for u in words[i]] for i in some]
        sizes = np.array([len(units) for units in ids])
        longest = int(sizes.max())
        units = np.zeros((len(some), longest), np.int64)
        inner = np.arange(longest) < sizes[:, None]
        units[inner] = [u for of in ids for u in of]
        names = [np.full(len(some), ~np.uint64(0)) for _ in self._any]
        for j in range(longest):  # the chains that are left for all units
            for column, of in zip(names, self._any, strict=True):
                column &= np.where(inner[:, j], of[units[:, j]], ~np.uint64(0))
        word = np.flatnonzero(functools.reduce(np.bitwise_or, names))
        names, last = [column[word] for column in names], np.full(len(word), len(self._codes), np.int16)
        text = np.zeros((len(word), longest), np.int16)
        for j in range(longest):
            if not len(word):
                break
            of = last.astype(np.int64) * self._any.shape[1] + units[word, j]
            many = self._many[of]
            grown = np.repeat(np.arange(len(word)), many)
            option = np.arange(len(grown)) + np.repeat(self._first[of] - np.cumsum(many) + many, many)
            left = [column[grown] & also[option] for column, also in zip(names, self._also, strict=True)]
            made = np.flatnonzero(functools.reduce(np.bitwise_or, left))
            grown, last, names = grown[made], self._letter[option[made]], [column[made] for column in left]
            word, text = word[grown], text[grown]
            text[:, j] = last
            over = sizes[word] == j + 1
            if over.any():
                ends = np.flatnonzero(over & self._legible[last, len(self._codes)])
                self._put(words, some, word[ends], text[ends, : j + 1], [column[ends] for column in names], out)
                rest = np.flatnonzero(~over)
                word, text, last, names = word[rest], text[rest], last[rest], [column[rest] for column in names]

    def _put(self, words: Sequence[Sequence[str]], some: list[int], word: np.ndarray, text: np.ndarray, names: list[np.ndarray], out: tuple[list[int], list[str], list[str]]) -> None:
        """Adds the texts that have different letters for different units and the same for the same."""
        different, which = np.unique(word, return_inverse=True)
        units = np.array([[words[some[w]].index(u) for u in words[some[w]]] for w in different.tolist()], np.int16 if text.shape[1] < 1 << 15 else np.int64)
        units = units.reshape(-1, text.shape[1])[which]
        fits, row = np.ones(len(word), bool), np.arange(len(word))
        unit_of, letter_of = np.full((len(self._codes), len(word)), -1, units.dtype), np.full(units.T.shape, -1, np.int16)
        for u, v in zip(np.ascontiguousarray(units.T), np.ascontiguousarray(text.T), strict=True):
            known, shown = letter_of[u, row], unit_of[v, row]
            fits &= ((known < 0) | (known == v)) & ((shown < 0) | (shown == u))
            letter_of[u, row], unit_of[v, row] = v, u
        texts = np.ascontiguousarray(self._codes[text[fits]]).view(f"<U{text.shape[1]}").ravel().tolist()
        for w, made, bits in zip(word[fits].tolist(), texts, zip(*(column[fits].tolist() for column in names), strict=True), strict=True):
            i = some[w]
            if made != "".join(words[i]):
                if bits not in self._names:
                    self._names[bits] = "|".join(chain for chain, n in self._bit.items() if bits[n >> 6] >> (n & 63) & 1)
                out[0].append(i)
                out[1].append(made)
                out[2].append(self._names[bits])


def substituted(wrong: list[str], right: list[str]) -> list[tuple[str, str]]:
    """The different (unit, letter) in which aligned stretches differ; none where a stretch can't be split evenly."""
    pairs: dict[tuple[str, str], None] = {}
    for unit, letters in zip(wrong, right, strict=True):
        if unit == letters or unit.lower() == letters or compose(unit).lower() == letters:
            continue
        width, rest = divmod(len(unit), len(letters))
        if rest or not width:
            return []
        for i, letter in enumerate(letters):
            part = unit[i * width : (i + 1) * width]
            if part.lower() != letter:
                pairs[part, letter] = None
    return list(pairs)


def shown_in_script(chain: str, letters: str, script_name: str) -> bool:
    """Whether a chain shows most letters of a script as other letters of it."""
    shown = [garble(ch, chain) or "" for ch in letters] if chain != UNNAMED and not chain.startswith("utf-8") else []
    return any(shown) and sum(script(s) == script_name for s in shown if len(s) == 1) > len(shown) / 2


def looks_so(unit: str, script_name: str) -> bool:
    """Whether a unit may be other spelling of something plain, or is all letters of the script."""
    own = all(script(ch) == script_name for ch in unit)
    return own or compose(unit) != unit or (len(unit) == 1 and look_alike(unit, script_name) is not None)


#: Signs of plain text besides letters and ASCII: guillemets as quotation marks.
_PLAIN_SIGNS = frozenset("«»")


class Units:
    """What one chain makes of the letters of one language, and the way back."""

    __slots__ = ("back", "chain", "lengths", "signs", "table", "usual")

    def __init__(self, chain: str, letters: str, own: str, others: str, strange: frozenset[tuple[str, str]] = frozenset()) -> None:
        back: dict[str, str] = {}
        lowered: dict[str, str] = {}
        for unit, letter in sorted(strange) if chain == UNNAMED else ():
            back.setdefault(unit, letter)
            lowered.setdefault(unit.lower(), letter)
        for ch in letters if chain != UNNAMED else "":
            for form in dict.fromkeys((ch, ch.upper())):
                if len(form) != 1:
                    continue
                unit = garble(form, chain)
                if unit and unit != form:
                    back.setdefault(unit, form)
                    lowered.setdefault(unit.lower(), form.lower())
        for unit, form in lowered.items():
            back.setdefault(unit, form)
        self.chain, self.back = chain, back
        self.signs = frozenset("".join(back))
        plain = own + own.upper() + others + others.upper() if chain.startswith("utf-8") else own + own.upper()
        self.usual = self.signs | frozenset(plain) | _PLAIN_SIGNS
        # one sign for each letter: no search is needed
        self.table = str.maketrans(back) if back and all(len(unit) == 1 for unit in back) else None
        self.lengths = _lengths(back)

    def undo(self, word: str) -> str:
        """The word with its units replaced, at each place the longest."""
        if self.table is not None:
            return word.translate(self.table)
        out, i, n = [], 0, len(word)
        while i < n:
            for size in self.lengths.get(word[i], ()):
                letter = self.back.get(word[i : i + size])
                if letter is not None:
                    out.append(letter)
                    i += size
                    break
            else:
                out.append(word[i])
                i += 1
        return "".join(out)


def _lengths(units: Iterable[str]) -> dict[str, tuple[int, ...]]:
    """First sign -> the lengths of the units that begin with it, longest first."""
    found: dict[str, set[int]] = {}
    for unit in units:
        found.setdefault(unit[0], set()).add(len(unit))
    return {ch: tuple(sorted(sizes, reverse=True)) for ch, sizes in found.items()}


class Repair:
    """The unit tables of one language's transformations ``kept``; ``strange``: the substitutions of the unnamed one."""

    def __init__(self, lang: Language, foreign: dict[str, frozenset[str]], kept: frozenset[str], strange: frozenset[tuple[str, str]] = frozenset()) -> None:
        own = "".join(sorted(lang.letters))
        # foreign words may stand in a list that went through UTF-8
        others = "".join(sorted(ch for s, known in foreign.items() if s != lang.script for ch in known if ch >= "\x80"))
        self.fine = frozenset(own + own.upper() + others + others.upper()) | _PLAIN_SIGNS | frozenset(map(chr, range(0x80)))
        self.units: list[Units] = []
        self._by_signs: dict[frozenset[str], list[Units]] = {}
        for chain in (*chains(lang.script), UNNAMED):
            if chain in kept:
                units = Units(chain, own + others if chain.startswith("utf-8") else own, own, others, strange)
                if units.back:
                    self.units.append(units)
        self._named: dict[str, str] = {}
        for units in self.units:
            for unit in units.back:
                self._named.setdefault(unit, units.chain)
        self._starts = _lengths(self._named)

    def seen(self, word: str) -> str | None:
        """The transformation of the first stretch of a word that one of them makes, if there is one."""
        if self._starts.keys().isdisjoint(word):
            return None
        for i, ch in enumerate(word):
            for size in self._starts.get(ch, ()):
                name = self._named.get(word[i : i + size])
                if name is not None:
                    return name
        return None

    def explanations(self, word: str) -> list[tuple[str, str]]:
        """[(chain, restored word)] of every chain that turns all of the word into plain letters.

        Each restored word holds letters of the language, of foreign words and ASCII; at least one
        unit was replaced.
        """
        signs = frozenset(ch for ch in word if ch >= "\x80")
        fit = self._by_signs.get(signs)
        if fit is None:
            fit = [u for u in self.units if signs <= u.usual and signs & u.signs]
            if len(self._by_signs) < 200_000:
                self._by_signs[signs] = fit
        found = []
        for units in fit:
            restored = units.undo(word)
            if restored != word and self.fine.issuperset(restored):
                found.append((units.chain, restored))
        return found


LOST = "\ufffd"


def odd_capitals(word: str) -> bool:
    """A capital right after a small letter, which a wrong table makes more often than a writer."""
    return any(a.islower() and b.isupper() for a, b in zip(word, word[1:]))


def is_stray(ch: str, lang: Language, foreign: dict[str, frozenset[str]]) -> bool:
    """A sign that belongs neither to the language nor to foreign words, formatting or look-alike spelling."""
    if ch < "\x80" or ch in _PLAIN_SIGNS or lang.has(ch):
        return False
    own = script(ch)
    if own and own != lang.script and (ch.lower() in foreign.get(own, ()) or look_alike(ch, lang.script)):
        return False
    if INVISIBLE.match(ch) or unicodedata.category(ch) in ("Mn", "Mc", "Zs") or ch in SIGNS:
        return False
    folded = unicodedata.normalize("NFKC", ch)
    raised = unicodedata.decomposition(ch).startswith(("<super>", "<sub>"))
    variant = folded != ch and unicodedata.category(ch)[0] in "LP" and not raised
    return not (variant and all(lang.has(c) or c < "\x80" for c in folded))


def has_stray(word: str, lang: Language, foreign: dict[str, frozenset[str]]) -> bool:
    """Whether the word holds a stray sign; verdicts on signs are kept with the language."""
    for ch in word:
        if ch >= "\x80":
            verdict = lang.strays.get(ch)
            if verdict is None:
                verdict = lang.strays[ch] = is_stray(ch, lang, foreign)
            if verdict:
                return True
    return False


#: Signs that stand for bytes without a sign.
_LOST_BYTE = re.compile("[\ufffd\x80-\x9f]")


def judge(
    word: str, lang: Language, foreign: dict[str, frozenset[str]], repair: Repair, pairs: Pairs
) -> tuple[bool, str | None, float, str | None]:
    """(whether the word shows a wrong decoding, the original or None, gain, the transformation).

    Where the word is legible as it is and a repair exists too, the first is False and ``gain`` tells
    how much more usual the letter pairs of the repaired word are. Without a learned stretch a word is
    no case, but for signs that stand for lost bytes.
    """
    if LOST in word:
        return True, None, 0.0, "lost bytes"
    name = repair.seen(word)
    lost = _LOST_BYTE.search(word) is not None
    if name is None and not lost:
        return False, None, 0.0, None
    ways = {r: chain for chain, r in reversed(repair.explanations(word)) if lang.own_script(r) or one_script(r)}
    if len(ways) > 1:
        best = max(sorted(ways), key=lambda r: (not odd_capitals(r), pairs.score(r, lang, foreign=True)))
    else:
        best = next(iter(ways), None)
    name = ways.get(best, name) or "lost bytes"
    if lost or has_stray(word, lang, foreign):
        return True, best, 0.0, name
    plain, other = plain_form(word, lang, foreign)
    if not lang.own_script(plain) and not one_script(plain):
        return True, best, 0.0, name
    if best is None:
        return False, None, 0.0, None
    legible = max(pairs.score(p, lang, foreign=True) for p in {plain, other})
    return False, best, pairs.score(best, lang, foreign=True) - legible, name
