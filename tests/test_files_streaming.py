from pyspark.sql import functions as F

from wordloom.functions import wiki
from wordloom.sources import files
from wordloom.streaming import merge


def test_raw_lists(spark, tmp_path):
    (tmp_path / "aaa_x.csv").write_text("﻿corpus,abc\nsubcorpus,-\nItem,Frequency\nword,100\ntest,50\nbad,1.0\nshort\n", encoding="utf-8")
    got = files.read_raw_lists(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.lang, r.word, r.frequency) for r in got] == [("aaa", "word", 100), ("aaa", "test", 50)]


def test_lists_written_and_read(spark, tmp_path):
    words = spark.createDataFrame([("nan", "a", 3), ("nan", "b", 5), ("dei", "c", 1)], "lang string, word string, frequency bigint")
    files.write_lists(words, str(tmp_path / "out"))
    back = spark.read.option("header", True).schema("word string, frequency bigint, lang string").csv(str(tmp_path / "out"))
    assert {tuple(r) for r in back.select("lang", "word", "frequency").collect()} == {("nan", "a", 3), ("nan", "b", 5), ("dei", "c", 1)}


def test_small_formats(spark, tmp_path):
    (tmp_path / "ignore.txt").write_text("# note\nfile_a.csv\n\nfile_b.csv # why\n")
    assert [r.file for r in files.read_ignored(spark, str(tmp_path / "ignore.txt")).collect()] == ["file_a.csv", "file_b.csv"]
    (tmp_path / "scripts.csv").write_text("name,code,type\nLatin;Latn;alphabet\nGreek,Grek,alphabet\n")
    assert {tuple(r) for r in files.read_script_codes(spark, str(tmp_path / "scripts.csv")).collect()} == {("Latin", "Latn"), ("Greek", "Grek")}
    (tmp_path / "x.conllu").write_text("# c\n1\tThe\tthe\tX\t_\t_\t_\t_\t_\t_\n1-2\tab\tab\tX\t_\t_\t_\t_\t_\t_\n2\tthe\tthe\tX\t_\t_\t_\t_\t_\t_\n\n")
    assert [(r.word, r.frequency) for r in files.read_conllu(spark, str(tmp_path / "x.conllu")).collect()] == [("the", 2)]
    (tmp_path / "b.xml").write_text("<a><seg id='1'>In the beginning</seg><seg id='2'>was</seg></a>")
    assert sorted(r.text for r in files.read_xml_segments(spark, str(tmp_path / "b.xml")).collect()) == ["In the beginning", "was"]


def test_stream_adds_only_new_files(spark, tmp_path):
    schema = "row_id bigint, file string, lang string, ord bigint, word string, frequency bigint, loaded_at timestamp"
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for n in (1, 2):
        spark.createDataFrame([(n, "aaa_x.csv", "aaa", n, "Hello", 10 * n, None)], schema).write.mode("append").parquet(source)
        merge.merge_new_files(merge.streamed_lines(spark, source), target, state).awaitTermination()
        assert spark.read.parquet(target).collect()[0].frequency == (10 if n == 1 else 30)


def test_wiki_text(frame):
    row = frame("t string, s string, u string", [("Foo language (Asia)", "about 1,200,000 people", "https://x/wiki/Foo_language?y")]).select(
        wiki.base_name(F.col("t")).alias("base"), wiki.speaker_count(F.col("s")).alias("n"), wiki.title_of_url(F.col("u")).alias("title"),
        wiki.plain_wikitext(F.lit("'''A''' [[B|C]] {{x|y}}<ref>z</ref> d")).alias("plain"), wiki.speaker_count(F.lit("2-4 million")).alias("m"),
    ).collect()[0]
    assert (row.base, row.n, row.title, row.plain, row.m) == ("Foo", 1200000.0, "Foo language", "A C d", 3e6)


def test_stream_adds_lines_delivered_again_once(spark, tmp_path):
    schema = "row_id bigint, file string, lang string, ord bigint, word string, frequency bigint, loaded_at timestamp"
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    runs = [[(1, "aaa_x.csv", "aaa", 1, "Hello", 10, None), (2, "aaa_x.csv", "aaa", 1, "Hello", 10, None), (3, "aaa_x.csv", "aaa", 2, "other", 7, None)], [(4, "aaa_x.csv", "aaa", 1, "hello", 5, None), (5, "aaa_x.csv", "aaa", 1, "Hello", 10, None), (6, None, None, 1, "x", 1, None)]]
    for rows in runs:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        merge.merge_new_files(merge.streamed_lines(spark, source), target, state).awaitTermination()
    assert {(r.lang, r.word): r.frequency for r in spark.read.parquet(target).collect()} == {("aaa", "hello"): 15, ("aaa", "other"): 7}


def test_lists_are_read_back_in_order(spark, tmp_path):
    words = spark.createDataFrame([("aaa", "b", 3), ("aaa", "a", 3), ("aaa", "c", 9), ("bbb", "x,\"y", 1)], "lang string, word string, frequency bigint")
    files.write_lists(words, str(tmp_path / "lists"))
    back = files.read_lists(spark, str(tmp_path / "lists")).collect()
    assert sorted((r.word, r.frequency) for r in back) == [("a", 3), ("b", 3), ("c", 9), ("x,\"y", 1)]
