"""Problem 8: texts packed into containers of a fixed number of tokens.

Method: lexical retrieval packing. Documents are spread over shards of bounded size; each shard has a
BM25 inverted index over the tokens of its documents. The largest unused document seeds a container;
the index returns its unused neighbours, which fill the window greedily: at each step the most
relevant neighbour is taken that leaves next to no room, or room that another unused document fills.
Only where no neighbour does so the one or two unused documents are taken that leave the least room.
Sparsely filled containers of a shard are opened again and their documents packed by size alone.
``chosen_by`` tells of each row what put it there: seed, index, size or piece (of a long text).

A text of more than the capacity is cut into full containers and one rest, which is packed like a
document; no other text is split. Edge cases: null and empty texts and texts without tokens are left
out; repeated rows are packed as rows of their own; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import tokens

#: Documents of a shard, on average; shards are hashed, so their sizes vary by a few per cent.
SHARD_DOCS = 4000
#: Room that may be left in a container, as a share of its capacity.
SPARE = 0.001
K1, B = 1.2, 0.75


class Bm25:
    """An inverted index of one shard. ``terms``, ``counts``: per document its distinct tokens and their counts."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray) -> None:
        n = len(terms)
        per_doc = np.array([len(t) for t in terms], np.int64)
        term = np.concatenate(terms).astype(np.int64) if n else np.zeros(0, np.int64)
        tf = np.concatenate(counts).astype(np.float64) if n else np.zeros(0)
        doc = np.repeat(np.arange(n), per_doc)
        norm = K1 * (1 - B + B * sizes / max(sizes.mean(), 1.0)) if n else sizes
        weight = tf * (K1 + 1) / (tf + norm[doc])
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        self.vocabulary, start, df = np.unique(term[order], return_index=True, return_counts=True)
        self.start, self.df = start, df
        # tokens that stand in half of the documents or more have no weight
        idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))
        self.weight = weight[order] * np.repeat(idf, df)
        self.telling = idf > 0
        self.n, self.terms = n, terms

    def scores(self, seed: int) -> np.ndarray:
        """The score of every document for the seed's tokens."""
        at = np.searchsorted(self.vocabulary, self.terms[seed])
        at = at[self.telling[at]]
        size = self.df[at]
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(self.n)
        where = np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1])
        return np.bincount(self.doc[where], self.weight[where], self.n)


class _Unused:
    """The unused documents by size."""

    def __init__(self, sizes: list[int]) -> None:
        self.rows = sorted((s, i) for i, s in enumerate(sizes))

    def drop(self, size: int, doc: int) -> None:
        del self.rows[bisect.bisect_left(self.rows, (size, doc))]

    def best(self, gap: int) -> tuple[int, int] | None:
        """The largest that fits."""
        at = bisect.bisect_right(self.rows, (gap, 1 << 60))
        return self.rows[at - 1] if at else None

    def best_pair(self, gap: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
        """The two that together leave the least room."""
        hi = bisect.bisect_right(self.rows, (gap, 1 << 60)) - 1
        if hi < 1:
            return None
        size = np.fromiter((s for s, _ in self.rows[: hi + 1]), np.int64, hi + 1)
        other = np.minimum(np.searchsorted(size, gap - size, "right") - 1, np.arange(hi + 1) - 1)
        total = np.where(other >= 0, size + size[np.maximum(other, 0)], -1)
        one = int(np.argmax(total))
        return (self.rows[one], self.rows[int(other[one])]) if total[one] > 0 else None


def pack_shard(sizes: list[int], capacity: int, index: Bm25 | None) -> list[list[tuple[int, str]]]:
    """Containers as lists of (document number, what chose it)."""
    unused = _Unused(sizes)
    free = np.ones(len(sizes), bool)
    array = np.array(sizes, np.int64)
    left = np.bincount(array, minlength=capacity + 1)  # unused documents of each size
    spare = int(SPARE * capacity)
    room = np.arange(capacity + 1)
    containers = []

    def take(doc: int, by: str, container: list[tuple[int, str]]) -> int:
        unused.drop(sizes[doc], doc)
        free[doc] = False
        left[sizes[doc]] -= 1
        container.append((doc, by))
        return sizes[doc]

    def neighbour(score: np.ndarray, gap: int) -> int | None:
        """The most relevant document after which the container is full or can be filled by one more."""
        largest = np.maximum.accumulate(np.where(left > 0, room, -1))
        closes = (room <= spare) | (largest >= room - spare)
        able = free & (array <= gap)
        able[able] = closes[gap - array[able]]
        found = np.where(able, score, 0.0)
        doc = int(found.argmax())
        return doc if found[doc] > 0 else None

    for seed in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if not free[seed]:
            continue
        container: list[tuple[int, str]] = []
        gap = capacity - take(seed, "seed", container)
        score = index.scores(seed) if index is not None and unused.best(gap) else None
        while fit := unused.best(gap):
            doc = neighbour(score, gap) if score is not None else None
            if doc is not None:
                gap -= take(doc, "index", container)
                continue
            smallest = unused.rows[0][0]
            chosen = (fit,)
            if gap < fit[0] + 2 * smallest:  # at most two more go in: close the gap
                pair = unused.best_pair(gap)
                chosen = pair if pair and pair[0][0] + pair[1][0] > fit[0] else (fit,)
            for _, doc in chosen:
                gap -= take(doc, "size", container)
        containers.append(container)
    return containers


def _repacked(containers: list[list[tuple[int, str]]], sizes: list[int], capacity: int) -> list[list[tuple[int, str]]]:
    """Sparse containers opened and packed again by size alone, where that needs fewer."""
    full = lambda c: sum(sizes[i] for i, _ in c) >= 0.97 * capacity
    sparse = [c for c in containers if not full(c)]
    docs = [i for c in sparse for i, _ in c]
    again = pack_shard([sizes[i] for i in docs], capacity, None)
    if len(again) >= len(sparse):
        return containers
    return [c for c in containers if full(c)] + [[(docs[i], by) for i, by in c] for c in again]


def _packed_numbers(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, two or four for each."""
    return values.astype("<u4" if len(values) and values.max() > 65535 else "<u2").tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def sized_documents(documents: DataFrame, ranks_path: str, lexicon_size: int) -> DataFrame:
    """(doc_id, size, distinct, terms, counts): tokens of each text; its distinct tokens and counts as bytes."""
    blocks = tokens.encoded_blocks(tokens.build_lexicon(documents, ranks_path, lexicon_size), ranks_path)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, ids in blocks(batches):
            found = [np.unique(ids[a:b], return_counts=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array([len(t) for t, _ in found]),
                    pa.array([_packed_numbers(t) for t, _ in found], pa.binary()),
                    pa.array([_packed_numbers(c) for _, c in found], pa.binary()),
                ],
                names=["doc_id", "size", "distinct", "terms", "counts"],
            )

    sized = tokens.with_pieces(documents, "doc_id").mapInArrow(measure, "doc_id bigint, size bigint, distinct bigint, terms binary, counts binary")
    return sized.filter("size > 0")


def pack(documents: DataFrame, capacity: int = 2048, ranks_path: str = tokens.RANKS, lexicon_size: int = tokens.LEXICON_SIZE, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(container, doc_id, piece, first_token, n_tokens, chosen_by): which container holds which document or piece."""
    shards = max(1, round(documents.filter(F.length("text") > 0).count() / shard_docs))
    sized = sized_documents(documents, ranks_path, lexicon_size).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "size"], kind="stable").reset_index(drop=True)
        size = rows["size"].to_numpy()
        rest = np.where(size > capacity, size % capacity, size)
        items = np.flatnonzero(rest > 0)
        terms, counts = ([_numbers(rows[name][i], rows["distinct"][i]) for i in items] for name in ("terms", "counts"))
        sizes = rest[items].tolist()
        packed = _repacked(pack_shard(sizes, capacity, Bm25(terms, counts, rest[items].astype(float))), sizes, capacity)
        out = []
        number = 0
        for container in packed:
            for item, by in container:
                doc = items[item]
                full = int(size[doc]) // capacity if size[doc] > capacity else 0
                out.append((number, rows["doc_id"][doc], full, full * capacity, int(rest[doc]), by))
            number += 1
        for doc in np.flatnonzero(size > capacity):
            for piece in range(int(size[doc]) // capacity):
                out.append((number, rows["doc_id"][doc], piece, piece * capacity, capacity, "piece"))
                number += 1
        result = pd.DataFrame(out, columns=["container", "doc_id", "piece", "first_token", "n_tokens", "chosen_by"])
        result["container"] += int(rows["shard"][0]) << 32
        return result

    return sized.groupBy("shard").applyInPandas(pack_group, "container bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint, chosen_by string")
