"""Problem 9: long exact spans that stand in more than one document.

Method: compact windows. The tokens of a text are its overlapping grams of ``GRAM`` characters, each
hashed. A Cartesian tree over the hashes, cut off where a node spans fewer than ``span - GRAM + 1``
grams, gives the compact windows (left, centre, right): all subsequences between left and right that
hold the centre share its hash as their minimum. A span of ``span`` characters that two texts share
has its minimum at the same place in both, so one hash finds every one of them. A window's key is the
hash of the centre's gram with more characters on its left or on its right (a span reaches that far on
one side at least). Windows with the same key are joined by their intervals: around the centre both
must reach far enough to hold a span. Documents of joined windows are verified on their texts.

A key that very many documents share (a notice a little shorter than a span) is not expanded to
pairs: its windows are keyed again by every full span around the centre, each span is verified on the
text of the first document that has it, and only documents that share a span are paired. Which
characters of a document stand elsewhere is told by such spans alone, without pairs.

Edge cases: null texts and texts shorter than a span share nothing; repeated rows of one document
share nothing with each other; texts are compared as stored, by code point, whole; ties of hashes
take the leftmost, and texts that repeat one gram are handled in time n log n; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import checkpointed

SPAN, GRAM = 200, 100
#: Members of a key up to which its documents are paired and verified directly.
DIRECT = 48
#: Document numbers that may be broadcast: 8 MB.
BROADCAST_IDS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Hasher:
    """Hashes of all stretches of a text, from sums of its characters times powers of a base."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers), 4096)
            with np.errstate(over="ignore"):
                for name, base in (("powers", self.base), ("inverses", self.inverse)):
                    steps = np.full(size, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def load(self, text: str) -> int:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self._grow(len(codes) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * self.powers[: len(codes)], dtype=np.uint64)))
        return len(codes)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Mixed hashes of the stretches of ``length`` at ``starts``."""
        with np.errstate(over="ignore"):
            h = (self.sums[starts + length] - self.sums[starts]) * self.inverses[starts]
            h ^= h >> np.uint64(30)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(27)
            h *= np.uint64(0x94D049BB133111EB)
            return h ^ (h >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """(left, centre, right) of the compact windows of ``width`` or more: Cartesian tree, cut at ``width``."""
    n = len(hashes)
    if n < width:
        return np.zeros((0, 3), np.int64)
    out, stack, budget = [], [(0, n)], 16 * (n // width + 4)
    while stack:
        lo, hi = stack.pop()
        if hi - lo < width:
            continue
        centre = lo + int(hashes[lo:hi].argmin())
        out.append((lo, centre, hi - 1))
        if len(out) > budget:
            # of a deep tree the centres are enough: the windows are taken to reach over the text
            deep = _centres_by_doubling(hashes, width)
            return np.stack((np.zeros_like(deep), deep, np.full_like(deep, n - 1)), axis=1)
        stack += [(lo, centre), (centre + 1, hi)]
    return np.array(out, np.int64).reshape(-1, 3)


def centres(hashes: np.ndarray, width: int) -> np.ndarray:
    """The places of the minima of all windows of ``width`` or more."""
    return windows(hashes, width)[:, 1]


def _centres_by_doubling(hashes: np.ndarray, width: int) -> np.ndarray:
    """The same for texts whose tree is deep (one gram repeated): leftmost minima of all windows of ``width``."""
    at, size = np.arange(len(hashes)), 1
    pick = lambda a, b: np.where(hashes[a] <= hashes[b], a, b)
    while 2 * size <= width:
        at = pick(at[: len(at) - size], at[size:])
        size *= 2
    shift = width - size
    return np.unique(pick(at[: len(at) - shift], at[shift:]) if shift else at)


def side_keys(hasher: Hasher, n: int, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, window, side) of the compact windows of a loaded text; side 0 reaches to the left, 1 to the right."""
    side = (span - gram + 1) // 2
    found = windows(hasher.at(np.arange(n - gram + 1), gram), span - gram + 1)
    left, right = found[found[:, 1] >= side], found[found[:, 1] + gram + side <= n]
    keys = np.concatenate((hasher.at(left[:, 1] - side, gram + side), hasher.at(right[:, 1], gram + side) ^ np.uint64(1)))
    return keys, np.concatenate((left, right)), np.repeat([0, 1], [len(left), len(right)])


_KEYS = {"key": np.int64, "doc_id": np.int64, "before": np.int32, "after": np.int32}


def window_keys(documents: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, doc_id, before, after): the keys of a document's windows and how far they reach around their centres."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {name: [np.zeros(0, kind)] for name, kind in _KEYS.items()}
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                key, window, _ = side_keys(hasher, hasher.load(text), span, gram)
                if not len(key):
                    continue
                # of windows with the same key those that reach furthest
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
                reach = (window[:, 1] - window[:, 0])[order], (window[:, 2] - window[:, 1])[order]
                row = (key[order][starts].view(np.int64), np.full(len(starts), doc), *(np.maximum.reduceat(r, starts) for r in reach))
                for name, values in zip(parts, row, strict=True):
                    parts[name].append(values.astype(_KEYS[name], copy=False))
            yield pd.DataFrame({name: np.concatenate(values) for name, values in parts.items()})

    texts = documents.filter(F.col("text").isNotNull() & (F.length("text") >= span)).select("doc_id", "text")
    return texts.mapInPandas(keys, "key bigint, doc_id bigint, before int, after int")


def _shared(keys: DataFrame, *by: str, **more: Column) -> DataFrame:
    """Rows whose key stands in more than one document, with ``members``.

    Members are counted by a partial aggregate, and a key that very many documents share is split by
    the join, so that no task holds all rows of a key.
    """
    counted = keys.groupBy(*by).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("members"), *(c.alias(n) for n, c in more.items()))
    return keys.join(counted.filter("low < high").drop("low", "high"), list(by))


def shared_windows(documents: DataFrame, span: int, gram: int) -> DataFrame:
    """The windows whose key stands in more than one document; windows are made once for their count and the join."""
    keys = window_keys(documents, span, gram).persist(StorageLevel.MEMORY_AND_DISK)
    shared = checkpointed(_shared(keys, "key"))
    keys.unpersist()
    return shared


def _pairs(shared: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of documents with windows of one key that both hold a span; each pair once."""
    a, b = (shared.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "before", "after"))) for x in "ab")
    room = F.least("before_a", "before_b") + F.least("after_a", "after_b") + 1
    joined = a.join(b, "key").filter((F.col("doc_id_a") < F.col("doc_id_b")) & (room >= span - gram + 1))
    return joined.select(F.col("doc_id_a").alias("doc_a"), F.col("doc_id_b").alias("doc_b")).distinct()


def _only(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The (doc_id, text) rows of the given documents, one per document."""
    few = ids.count() <= BROADCAST_IDS
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])


def common_spans(a: str, b: str, span: int, hasher: Hasher) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The stretches of a that stand in b, and of b that stand in a, as (start, end); runs of ``span`` or more."""
    n = hasher.load(a)
    if n < span or len(b) < span:
        return [], []
    in_a = hasher.at(np.arange(n - span + 1), span)
    m = hasher.load(b)
    in_b = hasher.at(np.arange(m - span + 1), span)
    out = []
    for text, own, other_text, other in ((a, in_a, b, in_b), (b, in_b, a, in_a)):
        starts = np.flatnonzero(np.isin(own, other))
        runs: list[tuple[int, int]] = []
        for start in starts.tolist():
            if runs and start <= runs[-1][1]:
                runs[-1] = (runs[-1][0], start + span)
            elif text[start : start + span] in other_text:
                runs.append((start, start + span))
        out.append(runs)
    return out[0], out[1]


_FOUND = "doc_a bigint, doc_b bigint, doc_id bigint, first bigint, last bigint"


def _verified(pairs: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """The pairs that share a span, with each shared stretch of either document."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            rows = []
            for doc_a, doc_b, a, b in zip(batch["doc_a"], batch["doc_b"], batch["text_a"], batch["text_b"], strict=True):
                in_a, in_b = common_spans(a, b, span, hasher)
                rows += [(doc_a, doc_b, doc_a, s, e) for s, e in in_a] + [(doc_a, doc_b, doc_b, s, e) for s, e in in_b]
            yield pd.DataFrame(rows, columns=["doc_a", "doc_b", "doc_id", "first", "last"])

    both = pairs.join(texts.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a")), "doc_a").join(
        texts.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b")), "doc_b"
    )
    return both.mapInPandas(verify, _FOUND)


def _full_spans(held: DataFrame, documents: DataFrame, span: int, gram: int) -> DataFrame:
    """(h1, h2, doc_id, first): every full span around the centres of the given (key, doc_id)."""
    wanted = held.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # a document's own windows
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull()).join(wanted, "doc_id")

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Hasher(), Hasher(_BASE ^ 0x5851F42D4C957F2C)
        side = (span - gram + 1) // 2
        for batch in batches:
            parts = [pd.DataFrame({name: np.zeros(0, np.int64) for name in ("h1", "h2", "doc_id", "first")})]
            for doc, text, keys in zip(batch["doc_id"], batch["text"], batch["keys"], strict=True):
                n = one.load(text)
                two.load(text)
                if n < span:
                    continue
                key, window, where = side_keys(one, n, span, gram)
                hit = np.isin(key.view(np.int64), np.asarray(keys, np.int64))
                left, centre, right = window[hit].T
                # a span with the minimum and `side` characters on that side: it may start this much earlier,
                # and all of its grams lie in the window
                early = np.maximum(centre - np.where(where[hit] == 0, span - gram, span - gram - side), left)
                late = np.minimum(centre - np.where(where[hit] == 0, side, 0), right - (span - gram))
                starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(early, late, strict=True)] or [np.zeros(0, np.int64)]))
                starts = starts[(starts >= 0) & (starts + span <= n)]
                h1, h2 = one.at(starts, span).view(np.int64), two.at(starts, span).view(np.int64)
                parts.append(pd.DataFrame({"h1": h1, "h2": h2, "doc_id": np.full(len(starts), doc), "first": starts}))
            yield pd.concat(parts, ignore_index=True)

    return texts.mapInPandas(expand, "h1 bigint, h2 bigint, doc_id bigint, first bigint")


def shared_starts(held: DataFrame, documents: DataFrame, span: int, gram: int) -> DataFrame:
    """(h1, h2, doc_id, first, members): spans that stand in more than one document, verified on the texts.

    Each span is compared with the text of the first document that has it: as many comparisons as
    spans, however many documents share one.
    """
    full = _full_spans(held, documents, span, gram)
    shared = checkpointed(_shared(full, "h1", "h2", rep=F.min(F.struct("doc_id", "first"))))
    places = F.collect_list(F.struct("h1", "h2", "first", F.col("rep.first").alias("rep_first"), "members")).alias("places")
    against = shared.groupBy("doc_id", F.col("rep.doc_id").alias("rep_doc")).agg(places)  # at most the spans of one document
    ids = checkpointed(against.select("doc_id").distinct())
    texts = _only(documents, ids)
    both = against.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("rep_doc"), F.col("text").alias("rep_text")), "rep_doc")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, rep, listed in zip(batch["doc_id"], batch["text"], batch["rep_text"], batch["places"], strict=True):
                rows += [(p["h1"], p["h2"], doc, p["first"], p["members"]) for p in listed if text[p["first"] : p["first"] + span] == rep[p["rep_first"] : p["rep_first"] + span]]
            yield pd.DataFrame(rows, columns=["h1", "h2", "doc_id", "first", "members"])

    return both.mapInPandas(verify, "h1 bigint, h2 bigint, doc_id bigint, first bigint, members bigint")


def _leading(starts: DataFrame) -> DataFrame:
    """Of spans that follow each other in the same documents only the first, which tells as much."""
    one = starts.dropDuplicates(["h1", "h2", "doc_id", "first"])
    before = one.select("doc_id", (F.col("first") + 1).alias("first"), F.struct("h1", "h2").alias("prev"), F.col("members").alias("prev_members"))
    linked = one.join(before, ["doc_id", "first"], "left")
    same = (F.count("prev") == F.count(F.lit(1))) & (F.min("prev") == F.max("prev")) & (F.min("prev_members") == F.max("members"))
    led = linked.groupBy("h1", "h2").agg(F.coalesce(same, F.lit(False)).alias("follows")).filter("not follows").drop("follows")
    return one.join(led, ["h1", "h2"])


def shared_spans(documents: DataFrame, span: int = SPAN, gram: int = GRAM, direct: int = DIRECT) -> DataFrame:
    """(doc_a, doc_b, doc_id, first, last): each pair that shares a span, with stretches [first, last) of both.

    Of pairs found by keys of more than ``direct`` documents only the first span of each stretch is given.
    """
    shared = shared_windows(documents, span, gram)
    pairs = checkpointed(_pairs(shared.filter(F.col("members") <= direct), span, gram))
    ids = pairs.select(F.col("doc_a").alias("doc_id")).unionByName(pairs.select(F.col("doc_b").alias("doc_id"))).distinct()
    found = _verified(pairs, _only(documents, checkpointed(ids)), span)
    held = shared.filter(F.col("members") > direct).select("key", "doc_id")
    if not held.isEmpty():
        full = checkpointed(_leading(shared_starts(held, documents, span, gram)))
        a = full.select("h1", "h2", F.col("doc_id").alias("doc_a"), F.col("first").alias("at_a"))
        b = full.select("h1", "h2", F.col("doc_id").alias("doc_b"), F.col("first").alias("at_b"))
        both = a.join(b, ["h1", "h2"]).filter("doc_a < doc_b")
        sides = F.explode(F.array(F.struct(F.col("doc_a").alias("doc_id"), F.col("at_a").alias("first")), F.struct(F.col("doc_b").alias("doc_id"), F.col("at_b").alias("first"))))
        more = both.select("doc_a", "doc_b", sides.alias("s")).select("doc_a", "doc_b", "s.doc_id", "s.first", (F.col("s.first") + span).alias("last"))
        found = found.unionByName(more)
    return found


def sharing_pairs(documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: each pair of documents that shares a span."""
    return shared_spans(documents).select("doc_a", "doc_b").distinct()


def shared_characters(documents: DataFrame, span: int = SPAN, gram: int = GRAM, direct: int = DIRECT) -> DataFrame:
    """(doc_id, n_chars, shared_chars) of every document: how many characters lie in spans that stand elsewhere.

    A span counts if another document has it, whichever; pairs are not made, so ``direct`` is of no account.
    """
    held = shared_windows(documents, span, gram).select("key", "doc_id")
    starts = shared_starts(held, documents, span, gram).select("doc_id", "first").distinct()
    by_doc = Window.partitionBy("doc_id").orderBy("first")
    # a span adds what lies beyond the end of the one before it
    reached = F.coalesce(F.lag("first").over(by_doc) + span, F.lit(0))
    added = F.col("first") + span - F.greatest(F.col("first"), reached)
    covered = starts.withColumn("added", added).groupBy("doc_id").agg(F.sum("added").alias("shared_chars"))
    sizes = documents.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("n_chars"))
    return sizes.join(covered, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0).cast("bigint")).alias("shared_chars"))
