import random

from wordloom.functions import text as T
from wordloom.operators import filters, frequency, quality
from pyspark.sql import functions as F

FILES = {
    "aaa_source1.csv": [("hello", 100), ("world", 80), *((w, 1) for w in ("apple", "banana", "cherry", "dog", "eagle", "frog", "grape", "house"))],
    "aaa_source2.csv": [("hello", 50), ("world", 40), *((w, 1) for w in ("apple", "banana", "cherry", "dog", "eagle", "frog"))],
    "aaa_source3.csv": [("привет", 60), ("мир", 40), ("дом", 20), ("кот", 1), ("лес", 1), ("сон", 1)],
    "bbb_source1.csv": [("alpha", 200), ("beta", 150), ("gamma", 50), ("delta", 1), ("epsilon", 1), ("zeta", 1)],
    "bbb_source2.csv": [("one", 100), ("two", 80), ("three", 30), ("four", 1), ("five", 1)],
}


def test_overlap_and_ignore_lists(lists):
    rows = frequency.lines(lists(FILES))
    pairs = filters.hapax_overlap(rows).collect()
    assert [(p.file_a, p.file_b, p.hapaxes_a, p.hapaxes_b, p.overlap, p.share_a_pct, p.share_b_pct) for p in pairs] == [
        ("aaa_source1.csv", "aaa_source2.csv", 8, 6, 6, 75.0, 100.0)
    ]
    overlap = filters.overlap_ignored(filters.top_pairs(filters.hapax_overlap(rows)))
    shares = filters.file_scripts(filters.script_letters(rows))
    ignored = filters.priority_union(overlap, filters.script_ignored(shares))
    assert {r.file for r in ignored.collect()} == {"aaa_source2.csv", "aaa_source3.csv"}
    kept = filters.without_ignored(rows, ignored)
    assert {r.word: r.frequency for r in frequency.merged(kept).collect()}["hello"] == 100


def test_greedy_skips_pairs_with_an_ignored_file(frame):
    pairs = frame(
        "lang string, file_a string, file_b string, share_a_pct double, share_b_pct double, place int",
        [("a", "f1", "f2", 90.0, 50.0, 1), ("a", "f1", "f3", 80.0, 20.0, 2), ("a", "f2", "f3", 10.0, 70.0, 3), ("a", "f4", "f5", 33.3, 1.0, 4)],
    )
    assert sorted(r.file for r in filters.overlap_ignored(pairs).collect()) == ["f1", "f3"]


def test_other_script(lists):
    rows = frequency.lines(lists({"aaa_1.csv": [("𐎠𐎡𐎢", 3)]}))
    got = filters.file_scripts(filters.script_letters(rows)).collect()[0]
    assert (got.script, got.pct) == ("Other", 100.0)


def test_quality(lists, frame):
    raw = lists({
        "aaa_1.csv": [("the", 100), ("of", 80), ("and", 60), ("to", 50), ("in", 40), ("a", 30), ("is", 20), ("it", 10)],
        "bbb_1.csv": [("hello", 100), ("www.google.com", 5), ("user@mail", 3)],
        "ccc_1.csv": [("a!", 100)],
        "ddd_1.csv": [("hello", 1), ("world", 1), ("привет", 1)],
        "eee_1.csv": [*(("a" + "bcdefghij"[i], 10) for i in range(9)), ("x" * 100, 1)],
    })
    scripts = frame("lang string, script string", [(c * 3, "Latin") for c in "abcd"])
    got = {r.file: r for r in quality.quality(frequency.lines(raw), scripts).collect()}
    assert (got["aaa_1.csv"].total_types, got["aaa_1.csv"].total_frequency, got["aaa_1.csv"].corrupted_pct) == (8, 390, 0.0)
    assert abs(got["bbb_1.csv"].corrupted_freq_pct - 100 * 8 / 108) < 1e-9
    assert got["ccc_1.csv"].punct_char_pct == 50.0
    assert got["ddd_1.csv"].foreign_script_pct > 0
    assert got["eee_1.csv"].long_outlier_pct > 0 and got["eee_1.csv"].foreign_script_pct == 0.0
    files = frame("file string", [("aaa_1.csv",), ("zzz_1.csv",)])
    scored = quality.quality(frequency.lines(raw), scripts)
    assert {r.file: r.total_types for r in quality.with_empty(scored, files).collect()} == {"aaa_1.csv": 8, "zzz_1.csv": 0}


def test_program_words(frame):
    yes = ["www.example.com", "http://x", "{json}", "path\\file", "user@email", "a.b.c", "1,2,3"]
    no = ["hello", "one.two", "a,b", "self-aware"]
    got = {r.w: r.p for r in frame("w string", [(w,) for w in yes + no]).select("w", T.is_program(F.col("w")).alias("p")).collect()}
    assert all(got[w] for w in yes) and not any(got[w] for w in no)


def test_dominant_script_of_any_script(frame):
    words = {"مرحبا": "Arabic", "漢字": "Han", "aб": "Latin", "бa": "Cyrillic", "abб": "Latin", "Γεια!": "Greek", "123": "Common", "𐎠": "Common", "": "Common", "שלום": "Hebrew", "हिन्दी": "Devanagari"}
    got = {r.w: r.s for r in frame("w string", [(w,) for w in words]).select("w", T.dominant_script(F.col("w")).alias("s")).collect()}
    assert got == words
    assert len(T.SCRIPTS) == 46


def test_words_in_scripts_beyond_four_are_foreign(lists, frame):
    raw = lists({"aaa_1.csv": [("hello", 3), ("مرحبا", 1), ("漢字", 1), ("aб", 1), ("бa", 1)]})
    got = quality.quality(frequency.lines(raw), frame("lang string, script string", [("aaa", "Latin")])).collect()[0]
    assert got.foreign_script_pct == 60.0


def test_stripped_signs_are_weighted(lists):
    raw = lists({"aaa_1.csv": [('"foo"', 3), ("bar", 5), ("...", 2), ("(x", 1)]})
    got = frequency.merge_report(frequency.lines(raw)).collect()[0]
    assert abs(got.avg_stripped - (3 * 2 + 1) / 11) < 1e-12 and got.tokens_raw == 11


def test_reasons_and_the_list_made_by_hand(lists, frame):
    rows = frequency.lines(lists(FILES))
    shares = filters.file_scripts(filters.script_letters(rows))
    overlap = filters.overlap_ignored(filters.top_pairs(filters.hapax_overlap(rows)))
    manual = filters.manual_ignored(frame("file string", [("aaa_source2.csv",)]))
    got = {r.file: r.reason for r in filters.priority_union(manual, overlap, filters.script_ignored(shares)).collect()}
    assert got == {"aaa_source2.csv": "manual ignore", "aaa_source3.csv": "file is 100.0% Cyrillic, but lang script is Latin (only 0.0% in file, need >= 75.0%)"}
    assert {r.reason for r in overlap.collect()} == {"100.0% hapax overlap with aaa_source1.csv"}


def test_pairs_above_a_threshold_like_all_pairs(lists):
    draw = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    files = {f"aaa_{n}.csv": [(w, 1) for w in {*words[:3], *draw.sample(words, draw.randint(1, 30))}] for n in range(14)} | {"bbb_1.csv": [("x", 1)], "bbb_2.csv": [("x", 1)], "ccc_1.csv": [("y", 2)]}
    rows = frequency.lines(lists(files))
    every = {tuple(r) for r in filters.hapax_overlap(rows).select("file_a", "file_b", "overlap", "share_a_pct", "share_b_pct").collect()}
    for threshold in (6.0, 33.3, 60.0, 99.0):
        got = {tuple(r) for r in filters.overlap_above(rows, threshold).select("file_a", "file_b", "overlap", "share_a_pct", "share_b_pct").collect()}
        assert got == {r for r in every if max(r[3:]) > threshold}
