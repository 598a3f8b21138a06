import math

from wordloom.operators import morphs as mo
from wordloom.operators import report, segment, statistics as stt
from wordloom.operators.compress import compression

SEG = "file string, word string, frequency double, segmentation string, annotation string"


def test_morph_metrics(frame):
    rows = [("f", "unbreakable", 50.0, "un+break+able", "A+R+A"), ("f", "rebuild", 30.0, "re+build", "A+R"), ("f", "cats", 20.0, "cat+s", "R+A"), ("f", "football", 10.0, "foot+ball", "R+R")]
    parsed = mo.parsed(frame(SEG, rows + rows[:1] + [("f", None, 1.0, "x", "R"), ("f", "y", 1.0, None, None)]))
    got = mo.morph_metrics(parsed).collect()[0]
    assert (got.words, got.word_tokens, got.morph_tokens) == (4, 110.0, 270.0)
    assert got.affix_deviation == 0.0
    inline = mo.inline_metrics(parsed).collect()[0]
    assert inline.avg_roots == 5 / 4 and inline.avg_interfixes == 0.0


def test_compounding_deviation_and_weights(frame):
    two = mo.morph_metrics(mo.parsed(frame(SEG, [("f", "a", 1.0, "p+q+r", "A+R+A"), ("f", "b", 1.0, "s+t", "R+R")]))).collect()[0]
    assert math.isclose(two.compounding_index, (1 / 3 + 1) / 2)
    weighted = mo.morph_metrics(mo.parsed(frame(SEG, [("f", "a", 100.0, "p+q+r", "A+R+A"), ("f", "b", 1.0, "s+t", "R+R")]))).collect()[0]
    assert math.isclose(weighted.weighted_morphs, 302 / 101)
    only = mo.morph_metrics(mo.parsed(frame(SEG, [("f", "a", 1.0, "p+q", "A+R")]))).collect()[0]
    assert only.affix_deviation is None


def test_role_entropies(frame):
    rows = [("f", "x", 50.0, "un+root+ly", "A+R+A"), ("f", "y", 50.0, "re+root+ed", "A+R+A")]
    got = {r.role: r for r in mo.role_metrics(mo.parsed(frame(SEG, rows))).collect()}
    assert math.isclose(got["affix"].entropy, 2.0) and got["affix"].morphs == 4
    assert (got["prefix"].morphs, got["suffix"].morphs) == (2, 2)


def test_clustering_and_ranks(frame):
    v = "g string, v double"
    same = stt.clustering(frame(v, [("a", 10.0), ("a", 10.0), ("b", 20.0), ("b", 20.0)]), "v", "g").collect()[0]
    assert (same.score, same.groups, same.pairs) == (1.0, 2, 2)
    assert stt.clustering(frame(v, [("a", 0.0), ("a", 100.0)]), "v", "g").collect()[0].score == 0.0
    one = stt.clustering(frame(v, [("a", 0.0), ("a", 4.0), ("a", 10.0)]), "v", "g").collect()[0]
    assert math.isclose(1 - one.score, (0.16 + 1 + 0.36) / 3)
    xy = frame("x double, y double", [(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)])
    assert math.isclose(stt.spearman(xy, "x", "y").collect()[0].spearman, 1.0)
    assert stt.spearman(frame("x double, y double", [(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)]), "x", "y").collect()[0].spearman is None
    tau = stt.kendall(frame("k int, x double, y double", [(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 3.0, 2.0)]), "x", "y", "k").collect()[0]
    assert tau.pairs == 3 and math.isclose(tau.tau, 1 / 3)


def test_elbow_and_suffix_slopes(frame):
    points = [("a", float(x), float(x if x <= 5 else 5 + 10 * (x - 5))) for x in range(1, 11)]
    table = frame("lang string, x double, y double", points)
    assert stt.elbow(table, "lang").collect()[0].x == 5.0
    slopes = {r.x: r.slope_after for r in stt.suffix_slopes(table, "lang").collect()}
    assert math.isclose(slopes[5.0], 10.0) and slopes[10.0] is None and slopes[9.0] is None


def test_break_test_and_whiskers(frame):
    bent = [("a", float(x), float(x if x <= 5 else 5 + 10 * (x - 5)) + 0.01 * (-1) ** x) for x in range(1, 11)]
    straight = [("b", float(x), float(x) + 0.5 * (-1) ** (x // 2)) for x in range(1, 11)]
    short = [("c", float(x), float(x)) for x in range(1, 4)]
    got = {r.lang: r for r in stt.break_test(frame("lang string, x double, y double", bent + straight + short), "lang").collect()}
    assert got["a"].x == 5.0 and got["a"].p < 1e-9 and got["b"].p > 0.01
    assert got["c"].f is None and got["c"].p is None
    # the tail of F(2, d) at f: for d = 6 and f = 5.1432528 it is 0.05 (tables)
    assert math.isclose((1 + 2 * 5.1432528 / 6) ** -3, 0.05, rel_tol=1e-5)
    box = stt.whiskers(frame("g string, v double", [("x", v) for v in (1.0, 2.0, 3.0, 4.0, 50.0, None)]), "v", "g").collect()[0]
    assert (box.q1, box.q3, box.low, box.high, box.outside) == (2.0, 4.0, 1.0, 4.0, 1)
    assert stt.whiskers(frame("g string, v double", []), "v", "g").count() == 0


def test_segmenter(frame):
    words = lambda rows: frame("lang string, word string, frequency bigint", [("x", w, f) for w, f in rows])
    parts = lambda rows, seg=segment.every_two: {r.word: r.frequency for r in segment.segmented_words(words(rows), seg).collect()}
    assert parts([("abcd", 100), ("abef", 50)]) == {"ab": 150, "cd": 100, "ef": 50}
    assert parts([("a", 10), ("b", 20)]) == {"a": 10, "b": 20}
    assert parts([("kept", 3)], lambda w: [" ", ""]) == {"kept": 3}


def test_compression_is_repeatable(frame):
    words = frame("lang string, word string, frequency bigint", [("x", f"ba{'na' * (i % 7)}{i}", 1 + i % 5) for i in range(200)])
    one, two = (compression(words, runs=1, sample=500).collect() for _ in range(2))
    assert one == two and one[0].zip_size < one[0].bin_size


def test_compression_has_six_runs(frame):
    words = frame("lang string, word string, frequency bigint", [("fra", "bade", 5), ("fra", "gode", 3)])
    assert sorted(r.run for r in compression(words, sample=20).collect()) == [0, 1, 2, 3, 4, 5]


def test_joins(frame):
    base = frame("lang string, n int", [("a", 1), ("b", 2)])
    other = frame("lang string, n int", [("a", 5)])
    got = report.left_joined(base, other, on="lang")
    assert got.columns == ["lang", "n", "n_2"] and {r.lang: r.n_2 for r in got.collect()} == {"a": 5, "b": None}
    line = report.latex_rows(frame("lang string, t bigint, v double", [("a&b", 1500, 0.5)]), ("lang",), ("t",), ("v",)).collect()[0].line
    assert line == r"a\&b & 1.5K & 0.500 \\"
