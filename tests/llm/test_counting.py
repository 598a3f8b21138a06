"""Problems 1, 5 and 6 against brute force, with nulls, ties, repeated rows, empty tables and extra columns."""

import random
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from wordloom.llm import cutoff, format_copies, terms

RAW = "row_id bigint, file string, lang string, ord bigint, word string, frequency bigint"
QUALITY = "file string, language string, checked_at timestamp, frequency double"  # a clashing extra column
TARGETS = "language string, target_pct int, n int"


def _raw(spark, rows):
    return spark.createDataFrame(rows, RAW).withColumn("n", F.lit("clash")).withColumn("letters", F.lit(1))


def test_cutoffs_like_brute_force(spark):
    draw = random.Random(3)
    rows, n = [], 0
    for file in ("aaa_1.csv", "aaa_2.csv", "bbb_1.csv", "ccc_1.csv"):
        for place in range(60):
            n += 1
            rows.append((n, file, None, place, None if draw.random() < 0.1 else "w", draw.choice([None, 0, 1, 1, 2, 3, 1 << 40])))
    rows += [(n + i, *r[1:]) for i, r in enumerate(rows[:50], 1)]  # delivered again
    quality = [("aaa_1.csv", "xx", None, 1.0), ("aaa_2.csv", "xx", None, 1.0), ("aaa_2.csv", None, None, 1.0), ("bbb_1.csv", "yy", None, 1.0)]
    targets = [("xx", 25, 1), ("yy", 60, 1), ("zz", 10, 1), (None, 5, 1)]
    got = cutoff.line_cutoffs(_raw(spark, rows), spark.createDataFrame(quality, QUALITY), spark.createDataFrame(targets, TARGETS))
    lines = {(r[1], r[3]): r[5] for r in rows if r[5] and r[5] >= 1}
    expected = {}
    for language, files, pct in (("xx", ("aaa_1.csv", "aaa_2.csv"), 25), ("yy", ("bbb_1.csv",), 60)):
        values = sorted((v for (f, _), v in lines.items() if f in files), reverse=True)
        cut = next(v for i, v in enumerate(values, 1) if i * 100 >= pct * len(values))
        expected[language] = (cut, sum(v >= cut for v in values))
    assert {r.language: (r.cutoff, r.kept) for r in got.collect()} == expected


def test_language_of_a_file_is_its_latest(spark):
    rows = spark.sql("select 'f' file, 'old' language, timestamp'2024-01-01' checked_at union all select 'f', 'new', timestamp'2024-02-01' union all select 'f', null, timestamp'2024-03-01'")
    assert [(r.file, r.language) for r in cutoff.file_languages(rows).collect()] == [("f", "new")]


def test_marks(spark):
    rows = [
        (1, "aaa_1.csv", None, 1, "(Foo!)", 1), (2, "aaa_1.csv", None, 2, "foo", 1), (3, "aaa_1.csv", None, 2, "foo", 1), (4, "aaa_1.csv", None, 3, "42", 9),
        (5, "aaa_1.csv", None, 4, None, 9), (6, "aaa_1.csv", None, 5, "bar", 1), (7, "aaa_2.csv", None, 1, "BAR\x85", 1), (8, "aaa_3.csv", None, 1, "baz", 3),
        (9, "aaa_3.csv", None, 2, "low", 0), (10, None, None, 1, "x", 1),
    ]
    got = {(r.term): (r.total, r.files, r.mark) for r in terms.marked_terms(_raw(spark, rows)).collect()}
    assert got == {"foo": (2, 1, "rare"), "bar": (2, 2, "common"), "baz": (3, 1, None)}
    ids = [r.term_id for r in terms.term_counts(terms.file_terms(_raw(spark, rows))).collect()]
    assert len(ids) == len(set(ids)) == 3


def test_empty_tables(spark):
    raw = _raw(spark, [])
    assert cutoff.line_cutoffs(raw, spark.createDataFrame([], QUALITY), spark.createDataFrame([], TARGETS)).count() == 0
    assert terms.marked_terms(raw).count() == 0
    assert format_copies.format_copies(raw, spark.createDataFrame([], "line_id bigint, file string, line string")).count() == 0


def test_copies_across_ranges_like_brute_force(spark):
    draw = random.Random(5)
    rows = [(i, "t", "f", draw.choice(["hot"] * 6 + list("abcdefgh"))) for i in range(600)]
    frame = spark.createDataFrame(rows, "id bigint, tbl string, file string, key string").select("tbl", "file", "key", "id")
    sets = defaultdict(list)
    for i, _, _, key in rows:
        sets[key].append(i)
    expected = {("t", min(v), x) for v in sets.values() for x in v if x != min(v)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")  # the hot key covers several ranges
    try:
        assert {tuple(r) for r in format_copies.copies(frame).collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_line_keys(spark):
    same = ["word=a-b c\tfrequency=2\tsource=web\tyear=2020", "YEAR : 2020 | WORD : (Ab  C) | FREQUENCY : 2 | SOURCE : Web.", " source=WEB ; year=2020 ; frequency=2 ; word='abc!' ;"]
    plain = ["abc|2|web|2020", "2020, web, 2, ABC.", "\t2 /ABC! /Web /2020  "]
    other = ["word=abc,frequency=3,source=web,year=2020", "cba|2|web|2020"]
    rows = [(i, "f", line) for i, line in enumerate([*same, *plain, *other, None, "  ", "odd"])]
    keys = {r.id: r.key for r in format_copies.line_keys(spark.createDataFrame(rows, "line_id bigint, file string, line string")).collect()}
    assert len({keys[i] for i in (0, 1, 2)}) == 1 and len({keys[i] for i in (3, 4, 5)}) == 1
    assert len({keys[i] for i in (0, 3, 6, 7, 10)}) == 5 and 8 not in keys and 9 not in keys


def test_word_copies(spark):
    rows = [(i, "dei_1.csv", None, i, w, f) for i, (w, f) in enumerate([("Foo-bar", 2), ("foo bar", 2), ("FOOBAR!", 2), ("foobar", 3), (None, 2), ("!!", 2), ("foobar", None)], 1)]
    rows.append((9, "dei_2.csv", None, 1, "foobar", 2))
    got = format_copies.format_copies(_raw(spark, rows), spark.createDataFrame([], "line_id bigint, file string, line string"))
    assert {tuple(r) for r in got.collect()} == {("raw_freq", 1, 2), ("raw_freq", 1, 3)}
    assert unicodedata.category("-")[0] == "P"


def test_blocks_and_ranges_sum_like_plain_counts(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(draw.choice(("aaa", "bbb")), f"f{i % 9}", draw.choice(["hot"] * 5 + list("abcdefgh")), draw.randint(1, 9)) for i in range(900)]
    frame = spark.createDataFrame(rows, "lang string, file string, term string, total bigint")
    monkeypatch.setattr(terms, "BLOCK_TERMS", 50)  # many blocks
    expected = defaultdict(lambda: [0, 0])
    for lang, _, term, total in rows:
        expected[lang, term][0] += total
        expected[lang, term][1] += 1
    got = terms.term_counts(frame).collect()
    assert {(r.lang, r.term): [r.total, r.files] for r in got} == expected
    assert len({r.term_id for r in got}) == len(got)


def test_ranges_of_copies_ship_no_number(spark):
    """Rows cross the exchange as (tbl, file, key, id) and come out sorted by the number of their key, then by id."""
    rows = [("raw_freq", "a", f"k{i % 50}", 1000 - i) for i in range(500)]
    done = format_copies.sorted_rows(spark.createDataFrame(rows, "tbl string, file string, key string, id bigint"), 4)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :].split("\n", 1)[1]
    assert "digest" not in below
    got = [(r.n, r.key, r.id) for r in done.selectExpr("xxhash64(tbl, file, key) n", "key", "id").collect()]
    assert got == sorted(got) and sorted(r[2] for r in got) == sorted(r[3] for r in rows)


def test_left_out_words_are_no_copies(spark):
    rows = [("raw_freq", "f", "k", 1, "rus", "x"), ("raw_freq", "f", "k", 2, None, None), ("raw_freq", "f", "k", 3, "rus", "y"), ("raw_freq", "f", "k", 4, "deu", "x")]
    keyed = spark.createDataFrame(rows, "tbl string, file string, key string, id bigint, lang string, word string")
    left_out = spark.createDataFrame([("rus", "x")], "lang string, word string")
    assert {tuple(r) for r in format_copies.copies(keyed, left_out).collect()} == {("raw_freq", 2, 3), ("raw_freq", 2, 4)}


def test_keys_are_not_made_again_to_leave_out_empty_ones(spark):
    """Filters know words and lines by any sign that their bare form keeps; lines of signs alone keep their old keys."""
    frame = _raw(spark, [(1, "dei_1.csv", None, 1, "Foo-bar", 2), (2, "dei_1.csv", None, 2, "!?", 2), (3, "dei_1.csv", None, 3, "é-", 2)])
    words, _ = format_copies.word_keys(frame)
    assert {(r.id, r.key) for r in words.collect()} == {(1, "2\x1ffoobar"), (3, "2\x1fé")}
    assert not any("Filter" in row and "regexp_replace" in row for row in words._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    lines = ["|||", "///", ",,,", "a|b\x1f|c|Σ", "Word=a\x1f,year=ΑΣ,x,source=1,frequency=2", "b;a;;b|", "word:a\tyear : b/source=,frequency=C,", "x=word=1"]
    rows = spark.createDataFrame([(i, "f", line) for i, line in enumerate(lines)], "line_id bigint, file string, line string")
    keyed = format_copies.line_keys(rows)
    assert {r.id: r.key for r in keyed.collect()} == {
        0: "\x1f" * 3, 1: "\x1f" * 3, 3: "a\x1fb\x1f\x1fc\x1fσ", 4: "frequency=2\x1fsource=1\x1fword=a\x1f\x1fyear=ασx",
        5: "\x1fa\x1fb\x1fb|", 6: "frequency=c\x1fsource=\x1fword=a\x1fyear=b", 7: "x=word=1",
    }
    assert any("Filter" in row and "RLIKE(line" in row for row in keyed._jdf.queryExecution().optimizedPlan().toString().split("\n"))
