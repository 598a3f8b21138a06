"""Problems 2 and 4 on small vocabularies with known transformations and disguises."""

import itertools
import random
import unicodedata

import pytest
import regex

from wordloom.llm import encoding_repair, forms, plain_text

RAW = "row_id bigint, file string, lang string, ord bigint, word string, frequency bigint"
CHAINS = {"fra": "utf-8>cp1252", "rus": "cp1251>cp1252", "ell": "utf-8>mac_roman"}
LETTERS = {"fra": ("bdfgklmnprst", "aeioué"), "rus": ("бвгдзклмнпрст", "аеиоуы"), "ell": ("βγδζθκλμνξπρ", "αεηιοάί")}


@pytest.fixture(scope="module")
def damaged(spark):
    """(rows, garbled row ids with originals, disguised row ids with plain spellings)."""
    draw = random.Random(11)
    rows, garbled, disguised = [], {}, {}
    ids = itertools.count(1)
    for lang, (consonants, vowels) in LETTERS.items():
        words = sorted({"".join(draw.choice(consonants) + draw.choice(vowels) for _ in range(draw.randint(2, 4))) for _ in range(400)})
        place = itertools.count(1)
        add = lambda word, lang=lang, place=place: rows.append((i := next(ids), f"{lang}_web_2020_1.csv", None, next(place), word, 2)) or i
        for word in words:
            add(word)
            add(word)
        for word in draw.sample([w for w in words if not w.isascii()], 25):
            garbled[add(forms.garble(word, CHAINS[lang]))] = word
        for word in draw.sample(words, 12):
            disguised[add(word[:1] + "\u200b" + word[1:])] = word
        for word in words[:6]:
            disguised[add("\u00a0" + word)] = " " + word
    for word in ("ﬁлм", None):
        rows.append((next(ids), "fra_web_2020_1.csv", None, 9999, word, 1))
    return rows, garbled, disguised


def test_wrong_decodings_are_found_and_undone(spark, damaged):
    rows, garbled, _ = damaged
    got = {r.row_id: r.original for r in encoding_repair.repaired_rows(spark.createDataFrame(rows, RAW)).collect()}
    assert len(set(garbled) - set(got)) <= 2 and len(set(got) - set(garbled)) <= 2
    assert sum(got.get(i) == w for i, w in garbled.items()) >= 0.95 * len(garbled)


def test_disguised_text_is_found_and_made_plain(spark, damaged):
    rows, garbled, disguised = damaged
    segmented = [(1, "fra_X-fra_Latn.tsv", "bаdé", "ba+dé"), (2, "fra_X-fra_Latn.tsv", "bade", "ba＋de"), (3, "fra_X-fra_Latn.tsv", "bade", None), (4, None, None, None), (5, "fra_X-fra_Latn.tsv", "bad", "bad")]
    frame = spark.createDataFrame(segmented, "seg_id bigint, file string, word string, segmentation string")
    got = plain_text.plain_rows(spark.createDataFrame(rows, RAW), frame).collect()
    raw = {r.row_key: r.plain for r in got if r.tbl == "raw_freq"}
    assert set(disguised) <= set(raw) and not set(raw) & set(garbled)
    assert all(raw[i] == w for i, w in disguised.items())
    assert {(r.row_key, r.field, r.plain) for r in got if r.tbl == "segmented"} == {(1, "word", "badé"), (2, "segmentation", "ba+de")}


def test_empty_tables(spark):
    raw = spark.createDataFrame([], RAW)
    assert encoding_repair.repaired_rows(raw).count() == 0
    assert plain_text.disguised_rows(raw, spark.createDataFrame([], "seg_id bigint, file string, word string, segmentation string")).count() == 0


def test_compose():
    for text, plain in (
        ("ｆｕｌｌ", "full"), ("éte", "éte"), ("a​b­c", "abc"), ("a b", "a b"), ("’s—x", "'s-x"), ("«a»", "«a»"),
        ("ɛ̃", "ɛ̃"), ("ﬃ", "ffi"), ("\U0001d41a\U0001d68b", "ab"), ("plain text\t!", "plain text\t!"), ("", ""), ("ά", "ά"),
        ("x" * 100_000 + "​", "x" * 100_000), ("ộx", "ộx"), ("​", ""),
    ):
        assert forms.compose(text) == plain


def test_look_alikes_and_foreign_words():
    latin = forms.Language("fra", "LATIN", "é")
    foreign = {"LATIN": frozenset("é"), "CYRILLIC": frozenset("абвгдежзийклмнопрстухцчшщыьэюя")}
    assert forms.plain_form("bоnе", latin, foreign)[0] == "bone"
    assert forms.plain_form("жить", latin, foreign) == ("жить", "жить")
    assert forms.plain_form("жить-bone", latin, foreign)[0] == "жить-bone"
    assert forms.plain_form("сор", latin, foreign) == ("cop", "сор")
    assert forms.plain_form("ѕор", latin, foreign) == ("sop", "sop")


def test_originals_without_odd_capitals_come_first():
    lang = forms.Language("war", "LATIN", "áéíóúýčěňřšůž")
    foreign = {"LATIN": lang.letters}
    repair = forms.Repair(lang, foreign, frozenset({"cp1250>cp1252", "cp1252>cp437"}))
    pairs = forms.Pairs({"war": {"^ž": 5, "žy": 5, "yš": 5, "še": 5, "ep": 5, "p$": 5}}, {"war": "LATIN"})
    assert {r for _, r in repair.explanations("žyèep")} == {"žyčep", "žyŠep"}
    assert forms.judge("žyèep", lang, foreign, repair, pairs)[:2] == (True, "žyčep")
    assert forms.odd_capitals("žyŠe") and not forms.odd_capitals("ŽYŠE") and not forms.odd_capitals("")


def test_fewest_chains():
    sets = {("a", "b"): 10, ("b",): 5, ("c", "d"): 4, ("e",): 1}
    assert encoding_repair.fewest_chains(sets) >= {"b"} and "e" not in encoding_repair.fewest_chains(sets)


def test_decomposed_lists_are_disguised(spark):
    """One list in decomposed spelling makes marks usual signs of its language; its rows are still found."""
    words = [a + b + c for a, b, c in itertools.product("bdgkl", "aeiu", ("só", "ną", "ro", "to"))]
    gon = [a + b + c for a, b, c in itertools.product("bdgkl", ("ɛ̃", "ɔ", "a"), "nst")]
    rows = [(i, f"pol_web_2020_{i % 4}.csv", None, i, w, 2) for i, w in enumerate(words)]
    rows += [(1000 + i, f"gon_web_2020_{i % 4}.csv", None, i, w, 2) for i, w in enumerate(gon)]
    apart = {w: unicodedata.normalize("NFD", w) for w in words if not w.isascii()}
    split = {2000 + i: w for i, w in enumerate(apart)}
    rows += [(i, "pol_web_2020_9.csv", None, i, apart[w], 2) for i, w in split.items()]
    rows += [(3000, "gon_web_2020_1.csv", None, 3000, "ba\u0303", 2), (3001, "gon_web_2020_1.csv", None, 3001, "\u212aan", 2)]
    frame = spark.createDataFrame([], "seg_id bigint, file string, word string, segmentation string")
    got = {r.row_key: r.plain for r in plain_text.plain_rows(spark.createDataFrame(rows, RAW), frame).collect()}
    assert got == {**split, 3000: "b\u00e3", 3001: "Kan"}


def test_composable_holds_all_that_nfc_joins():
    found = regex.compile(forms.COMPOSABLE)
    for ch in map(chr, range(0x80, 0x20000)):
        apart = unicodedata.normalize("NFD", ch)
        if unicodedata.is_normalized("NFC", ch) and apart != ch:
            assert found.search(apart), hex(ord(ch))
    assert not found.search("ɛ̃") and not found.search("ɔ̀") and found.search("ba\u0303")


def _listed(words, misread, rare=()):
    """Rows of ten files of words, and of one file of the same words as ``misread`` shows them: {row_id: word}."""
    rows = [(i * 10 + f, f"ces_web_2020_{f}.csv", None, i, w, 2) for i, w in enumerate(words) for f in range(10)]
    rows += [(90_000 + 10 * i + f, f"ces_web_2020_{f}.csv", None, 9000 + i, w, 2) for i, w in enumerate(rare) for f in range(10)]
    wrong = {100_000 + i: (w, forms.garble(w, misread)) for i, w in enumerate(words)}
    wrong = {i: pair for i, pair in wrong.items() if pair[0] != pair[1]}
    return rows + [(i, "ces_web_2020_99.csv", None, i, w, 2) for i, (_, w) in wrong.items()], {i: w for i, (w, _) in wrong.items()}


def test_letters_of_one_misread_list_are_not_usual(spark):
    """All signs of the misread list are Latin letters; a letter in one of a hundred lines of each file is usual."""
    words = [a + b + c for a, b, c in itertools.product("bdgkl", "aeiu", ("ř", "č", "ňo", "ro", "to", "ně"))]
    rows, wrong = _listed(words, "cp1250>cp1252", rare=("hůl", "kůl"))
    got = {r.row_id: r.original for r in encoding_repair.repaired_rows(spark.createDataFrame(rows, RAW)).collect()}
    assert got == wrong


def test_misreading_of_one_small_language_is_kept(spark, monkeypatch):
    """With a large share of all explained words asked for, as a large table does, few words of one language do."""
    monkeypatch.setattr(encoding_repair, "LEAST_SHARE", 0.4)
    draw = random.Random(5)
    rows, wrong = [], {}
    for lang, chain, damaged in (("fra", "utf-8>cp1252", 60), ("rus", "koi8-r>cp1251", 12)):
        consonants, vowels = LETTERS[lang]
        words = sorted({"".join(draw.choice(consonants) + draw.choice(vowels) for _ in range(4)) for _ in range(300)})
        rows += [(len(rows) + i, f"{lang}_web_2020_{i % 3}.csv", None, i, w, 2) for i, w in enumerate(words * 2)]
        for w in [w for w in words if not w.isascii()][:damaged]:
            wrong[len(rows)] = w
            rows.append((len(rows), f"{lang}_web_2020_7.csv", None, len(rows), forms.garble(w, chain), 2))
    got = {r.row_id: r.original for r in encoding_repair.repaired_rows(spark.createDataFrame(rows, RAW)).collect()}
    assert got == wrong


def test_rare_letters_and_large_inventories_are_no_cases(spark):
    """Loan words with letters that stand in few lines, and syllables of which none is usual."""
    draw = random.Random(3)
    german = sorted({"".join(draw.choice("bdfgklmnprst") + draw.choice(("a", "e", "i", "o", "u", "ä", "ö", "ü")) for _ in range(3)) for _ in range(500)})
    hangul = ["".join(chr(0xAC00 + draw.randrange(11172)) for _ in range(draw.randint(1, 4))) for _ in range(1500)]
    rows = [(i, f"deu_web_2020_{i % 7}.csv", None, i, w, 2) for i, w in enumerate([*german, "café", "rené", "garçon", "señor", "Café"])]
    rows += [(10_000 + i, f"kor_web_2020_{i % 5}.csv", None, i, w, 2) for i, w in enumerate(hangul)]
    assert encoding_repair.repaired_rows(spark.createDataFrame(rows, RAW)).count() == 0


def test_without_learned_mappings_only_lost_bytes_are_found(spark, damaged, monkeypatch):
    rows, garbled, _ = damaged
    rows = [*rows, (9_000, "fra_web_2020_1.csv", None, 9_000, "ab�", 1), (9_001, "fra_web_2020_1.csv", None, 9_001, "ab\x81c", 1)]
    frame = spark.createDataFrame(rows, RAW)
    named = {r.row_id: r.mapping for r in encoding_repair.repaired_rows(frame).collect()}
    assert all(named[i] for i in named) and set(garbled) <= set(named)
    monkeypatch.setattr(encoding_repair, "learn", lambda *_: None)
    got = {r.row_id: r.mapping for r in encoding_repair.repaired_rows(frame).collect()}
    assert {9_000, 9_001} <= set(got) and set(got.values()) == {"lost bytes"}
    assert all("�" in w or any("\x80" <= ch <= "\x9f" for ch in w) for i, _, _, _, w, _ in rows if i in got)


def test_substitutions_of_no_listed_encoding_are_learned(spark):
    words = ["".join(p) for p in itertools.product("bdgkl", ("é", "a"), "mnr", ("o", "é"), "st")]
    rows = [(i, f"fra_web_2020_{i % 3}.csv", None, i, w, 2) for i, w in enumerate(words * 2)]
    wrong = {1000 + i: w for i, w in enumerate([w for w in words if "é" in w][::5])}
    rows += [(i, "fra_web_2020_9.csv", None, i, w.replace("é", "☃¤"), 2) for i, w in wrong.items()]
    got = {r.row_id: (r.original, r.mapping) for r in encoding_repair.repaired_rows(spark.createDataFrame(rows, RAW)).collect()}
    assert got == {i: (w, "learned") for i, w in wrong.items()}


def test_texts_of_many_twins_show_what_stands_for_what(spark):
    """Every stripped text has ten clean words, every word of the other script has one of two patterns of hundreds."""
    words = {"fra": ["".join(p) for p in itertools.product("bdgk", "áàâäæéèêëí", "mn", ("st", "rt"))]}
    words["rus"] = ["".join(p) for p in itertools.product("бвгд", "ау", "клмн", "иоы")]
    rows, wrong = [], {}
    for lang, chain in (("fra", "utf-8>cp1252"), ("rus", "cp1251>cp1252")):
        rows += [(len(rows) + i, f"{lang}_web_2020_{i % 3}.csv", None, i, w, 2) for i, w in enumerate(words[lang] * 2)]
        for w in words[lang][::5]:
            wrong[len(rows)] = w
            rows.append((len(rows), f"{lang}_web_2020_9.csv", None, len(rows), forms.garble(w, chain), 2))
    got = {r.row_id: r.original for r in encoding_repair.repaired_rows(spark.createDataFrame(rows, RAW)).collect()}
    assert got == wrong


def test_votes_of_many_twins_weigh_little(spark):
    """Of a sign that no encoding makes, a word with one twin tells all and words with many twins tell little."""
    keyed = [("rus", f"☃{i}ка", False, "1,2,3,4", ["☃", str(i), "к", "а"]) for i in range(3)]
    keyed += [("rus", w, True, "1,2,3,4", list(w)) for w in ("бока", "вока", "гока", "дока")]
    keyed += [("rus", "☃мам", False, "1,2,3,2", ["☃", "м", "а", "м"]), ("rus", "бумам", True, "1,2,3,2", ["б", "у", "м", "у"])]
    frame = spark.createDataFrame([("rus", "абвгдкмоу", False, False, False)], "lang string, letters string, latin boolean, cased boolean, marks boolean")
    votes = encoding_repair.open_votes(spark.createDataFrame(keyed, "lang string, word string, clean boolean, key string, units array<string>"), frame)
    got = {r.v: r.parts / encoding_repair.PARTS for r in votes.filter("u = '☃'").collect()}
    assert got == {"б": 1 + 3 / 16, "в": 3 / 16, "г": 3 / 16, "д": 3 / 16}


def test_originals():
    pairs = frozenset(map("".join, itertools.product("^абв", "абв$")))
    ways = forms.Originals("абв", "CYRILLIC", pairs)
    assert "cp1251>cp1252" in ways.of(list("àáâ"))["абв"].split("|") and ways.of(list("ààâ"))["аав"]
    assert ways.of(list("à☃â")) == {} and forms.Originals("абв", "CYRILLIC", pairs - {"аб"}).of(list("àáâ")) == {}


def test_letter_pairs_by_brute_force(spark):
    words = [("rus", "слово"), ("rus", "волос"), ("deu", "größe"), ("deu", "a"), ("deu", "𝒜bb"), ("rus", "о")]
    expected = {}
    for code, word in words:
        for pair in map("".join, zip(f"^{word}$", f"{word}$")):
            expected[code, pair] = expected.get((code, pair), 0) + 1
    got = encoding_repair.letter_pairs(spark.createDataFrame(words, "lang string, word string"))
    assert {(r.lang, r.pair): r.n for r in got.collect()} == expected


def test_twin_keys_without_generated_rows(spark):
    """Patterns are made of whole batches of words, their units are not listed."""
    languages = spark.createDataFrame([("fra", "é", True, False, False), ("rus", "абвг", False, False, False)], "lang string, letters string, latin boolean, cased boolean, marks boolean")
    words = [("fra", "bébé", 2), ("fra", "é", 1), ("fra", "a\u2028éb", 1), ("fra", "bÃ©b", 1), ("rus", "абаб", 3), ("rus", "àáàáàáàá", 1), ("rus", "абx", 1), ("rus", "аба", 1)]
    keyed = encoding_repair.twin_keys(spark.createDataFrame(words, "lang string, word string, n bigint"), languages)
    assert "Generate" not in keyed._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.word, r.clean, r.key, tuple(r.units or ()), r.width) for r in keyed.collect()} == {
        ("bébé", True, "b\x01b\x01", ("é", "é"), 0), ("bÃ©b", False, "b\x01b", ("Ã©",), 0), ("абаб", True, "1,2,1,2", (), 1),
        ("àáàáàáàá", False, "1,2,1,2,1,2,1,2", (), 1), ("àáàáàáàá", False, "1,1,1,1", (), 2),
    }


def test_originals_of_many_words_like_brute_force():
    """All words of a batch at once: different lengths, unknown units, units of several signs, one bit for chains that do the same."""
    draw = random.Random(4)
    pairs = frozenset(a + b for a, b in itertools.product("^абвг", "абвг$") if draw.random() < 0.8)
    shown = {c: {forms.garble(ch, c): None for ch in "абвгАБВГ"} for c in ("utf-8>cp1252", "cp1251>koi8-r", "cp866>cp1251")}
    words = [tuple(draw.choice([u for u in shown[c] if u]) for _ in range(draw.randint(0, 5))) for c in shown for _ in range(60)] + [("☃", "à")]
    expected = {}
    for i, units in enumerate(words):
        for letters in itertools.product("абвг", repeat=len(units)):
            names = set(forms.chains("CYRILLIC")).intersection(*(forms.chains_of(u, v, "CYRILLIC") for u, v in zip(units, letters)))
            text = "".join(letters)
            legible = all(a + b in pairs for a, b in zip(f"^{text}", f"{text}$"))
            if units and names and legible and text != "".join(units) and len(set(units)) == len(set(text)) == len(set(zip(units, letters))):
                expected[i, text] = names
    ways = forms.Originals("абвг", "CYRILLIC", pairs)
    got = {(i, text): set(names.split("|")) for i, text, names in zip(*ways.of_all(words), strict=True)}
    assert got == expected and len(got) > 50
