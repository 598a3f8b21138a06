from wordloom.operators import compress


def test_draws_with_replacement(frame):
    words = frame("lang string, word string, frequency bigint", [("aaa", "hot", 900), ("aaa", "b", 90), ("aaa", "rare", 10), ("bbb", "x", 1)])
    rows = compress.drawn_tokens(words, runs=2, sample=1000).collect()
    times = {(r.lang, r.run, r.word): r.times for r in rows}
    for lang in ("aaa", "bbb"):
        assert all(sum(n for (l, run, _), n in times.items() if (l, run) == (lang, k)) == 1000 for k in (0, 1))
    assert 850 < times["aaa", 0, "hot"] < 950 and times["bbb", 1, "x"] == 1000
    again = compress.drawn_tokens(words, runs=2, sample=1000)
    assert {(r.lang, r.run, r.word): r.times for r in again.collect()} == times
    sizes = {(r.lang, r.run): (r.unique_chars, r.tokens, r.bin_size) for r in compress.sample_sizes(again).collect()}
    assert sizes["bbb", 0] == (1, 1000, 2 * 1000 + 2 * 999)


def test_draws_of_an_empty_table(frame):
    assert compress.drawn_tokens(frame("lang string, word string, frequency bigint", []), runs=2).count() == 0
