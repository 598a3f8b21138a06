"""Problem 7: token ids of every text by a public byte-level BPE tokenizer.

Method. Texts are cut into pieces by the tokenizer's own pattern inside the JVM. The pieces of the
whole corpus are counted; the most frequent ones are compiled, with their ids as outputs, into a
minimal acyclic automaton with shared prefixes and suffixes (each edge carries how many words lie
before it, so the path of a word adds up to the number of its output). The automaton is one file in
the cluster's shared folder, which tasks map into memory. A task looks up the distinct pieces of a
block all at once; pieces that are not in the automaton are merged exactly by the tokenizer's ranks.
The size of the lexicon changes the speed only, never an id.

Edge cases: null and empty texts give an empty list; strings that look like special tokens are
ordinary text; repeated rows give a row each; very long texts and pieces are handled whole (merging
takes n log n); other columns are kept out of the tasks. Texts with characters that the JVM's
Unicode version does not know are cut in Python with the same pattern.
"""

from __future__ import annotations

import base64
import heapq
import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizers' rank files lie.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces in the lexicon.
LEXICON_SIZE = 32_768
_WS = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Fixed value: the pattern of byte-level BPE, with white space spelled out for the JVM.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
_PIECES_PY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the adjacent pair of lowest rank is joined, the leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0: no part starts here
    before = list(range(-1, n - 1))
    queue = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            joined = piece[i : end[stop]]
            if joined in ranks:
                heapq.heappush(queue, (ranks[joined], i, end[stop]))
        if (left := before[i]) >= 0:
            joined = piece[left:stop]
            if joined in ranks:
                heapq.heappush(queue, (ranks[joined], left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


# ---------------------------------------------------------------- lexicon automaton


def compile_lexicon(entries: dict[bytes, list[int]]) -> np.ndarray:
    """The automaton of the entries and their outputs, as one array of int64.

    Layout: numbers of edges, nodes, words, ids; then per edge (sorted by node * 256 + byte) its key,
    target and number of words before it; per node whether a word ends; per word the start of its ids
    (and the end of the last); the ids.
    """
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    edges: list[list[tuple[int, int]]] = []
    ends: list[bool] = []
    # the path of the last word: per node [ends, [(byte, node number)]], not yet registered
    path: list[list] = [[False, []]]
    last = b""

    def freeze(down_to: int) -> None:
        while len(path) > down_to + 1:
            final, out = path.pop()
            key = (final, tuple(out))
            number = register.get(key)
            if number is None:
                number = register[key] = len(edges)
                edges.append(out)
                ends.append(final)
            path[-1][1].append((last[len(path) - 1], number))

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        freeze(common)
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    freeze(0)
    final, out = path[0]
    edges.append(out)
    ends.append(final)
    root = len(edges) - 1
    below = [0] * len(edges)  # children always have lower numbers
    rows = []
    for node, out in enumerate(edges):
        count = int(ends[node])
        for byte, target in out:
            rows.append(((root - node) * 256 + byte, root - target, count))  # the root becomes node 0
            count += below[target]
        below[node] = count
    rows.sort()
    ids = [entries[w] for w in words]
    starts = np.cumsum([0, *map(len, ids)])
    table = np.array(rows, np.int64).reshape(-1, 3)
    flat = np.array([i for part in ids for i in part], np.int64)
    head = [len(rows), len(edges), len(words), len(flat)]
    return np.concatenate([np.array(head, np.int64), *table.T, np.array(ends[::-1], np.int64), starts.astype(np.int64), flat])


class Lexicon:
    """A compiled lexicon, usually mapped into memory."""

    def __init__(self, data: np.ndarray) -> None:
        edges, nodes, words, n_ids = map(int, data[:4])
        at = np.cumsum([4, edges, edges, edges, nodes, words + 1, n_ids])
        self.key, self.target, self.skip, self.ends, self.start, self.ids = (data[a:b] for a, b in zip(at, at[1:], strict=False))
        self.words = words

    def number(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of each word (bytes ``text[offsets[i]:offsets[i + 1]]``), or -1."""
        n = len(offsets) - 1
        out = np.full(n, -1, np.int64)
        length = np.diff(offsets)
        live = np.flatnonzero(length > 0)
        state = np.zeros(len(live), np.int64)
        total = np.zeros(len(live), np.int64)
        step = 0
        while len(live) and len(self.key):
            wanted = state * 256 + text[offsets[live] + step]
            edge = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[edge] == wanted
            live, edge = live[hit], edge[hit]
            state, total = self.target[edge], total[hit] + self.skip[edge]
            step += 1
            over = length[live] == step
            good = over & (self.ends[state] == 1)
            out[live[good]] = total[good]
            live, state, total = live[~over], state[~over], total[~over]
        return out


class Encoder:
    """Encodes blocks of pieces: automaton first, exact merging for the rest."""

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]) -> None:
        self.lexicon, self.ranks = lexicon, ranks
        self.merged: dict[bytes, list[int]] = {}

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first id, number of ids of each word, the ids they point to)."""
        n = len(words)
        _, offsets, data = words.buffers()
        kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
        offsets = np.frombuffer(offsets, kind)[words.offset : words.offset + n + 1].astype(np.int64)
        text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        number = self.lexicon.number(text, offsets)
        known = np.maximum(number, 0)
        first = np.asarray(self.lexicon.start[known])
        count = np.asarray(self.lexicon.start[known + 1]) - first if self.lexicon.words else np.zeros(n, np.int64)
        extra: list[int] = []
        base = len(self.lexicon.ids)
        for i in np.flatnonzero(number < 0).tolist():
            piece = text[offsets[i] : offsets[i + 1]].tobytes()
            ids = self.merged.get(piece)
            if ids is None:
                ids = merge(piece, self.ranks) if piece else []
                if len(self.merged) < 300_000:
                    self.merged[piece] = ids
            first[i], count[i] = base + len(extra), len(ids)
            extra += ids
        return first, count, np.concatenate([self.lexicon.ids, np.array(extra, np.int64)])

    def lists(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of lists of pieces; a null list counts as empty."""
        size = pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pieces.flatten().dictionary_encode()
        first, count, ids = self.words(flat.dictionary)
        code = flat.indices.to_numpy()
        each = count[code]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        spread = np.repeat(first[code] - (ends - each), each) + np.arange(total)
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(size)))]
        return at, ids[spread]


# ---------------------------------------------------------------- Spark side


def pieces_of(text: Column) -> Column:
    """The pieces of a text; null where the text holds characters unknown to the JVM."""
    return F.when(~text.rlike(r"\p{Cn}"), F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)))


def frequent_pieces(documents: DataFrame, size: int = LEXICON_SIZE) -> DataFrame:
    """(piece, n): the most frequent pieces of all texts, at most ``size``; pieces of about one count stay together.

    The least count is found from the number of pieces per eighth of a power of two (a few hundred
    rows), so that no task sends a list of its own to the driver.
    """
    counted = documents.select(F.explode(pieces_of(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 8)).persist(StorageLevel.MEMORY_AND_DISK)
    least, taken = 1 << 20, 0
    for row in sorted(counted.groupBy("step").agg(F.count(F.lit(1)).alias("pieces")).collect(), reverse=True):
        taken += row.pieces
        if taken > size:
            break
        least = row.step
    return counted.filter(F.col("step") >= least).select("piece", "n")


def share_array(spark: SparkSession, data: np.ndarray, name: str) -> str:
    """Writes ``data`` to the cluster's shared folder and hands it to all executors; its file name."""
    from wordloom.session import checkpointed

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        checkpointed(spark.range(1))  # sets the folder
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    file = f"{name}-{uuid.uuid4().hex}.npy"
    buffer = io.BytesIO()
    np.save(buffer, data)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder, file)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    view = buffer.getvalue()
    for at in range(0, len(view), 1 << 20):
        out.write(bytearray(view[at : at + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return file


def build_lexicon(documents: DataFrame, ranks_path: str = RANKS, size: int = LEXICON_SIZE) -> str:
    """Compiles the frequent pieces of the documents; the shared file's name. At most ``size`` rows are collected."""
    ranks = load_ranks(ranks_path)
    words = [row.piece.encode() for row in frequent_pieces(documents, size).select("piece").collect()]
    return share_array(documents.sparkSession, compile_lexicon({w: merge(w, ranks) for w in words}), "lexicon")


#: Pieces that a task encodes at once.
_BLOCK = 400_000


def encoded_blocks(lexicon_file: str, ranks_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
    """A generator function for tasks: (rows, offsets, ids) of blocks of rows with columns pieces and whole."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        encoder = Encoder(Lexicon(np.load(SparkFiles.get(lexicon_file), mmap_mode="r")), load_ranks(ranks_path))
        for batch in batches:
            whole = batch.column("whole")
            pieces = batch.column("pieces")
            if whole.null_count < len(whole):
                cut = [_PIECES_PY.findall(w) if w is not None else p for w, p in zip(whole.to_pylist(), pieces.to_pylist(), strict=True)]
                pieces = pa.array(cut, pa.list_(pa.string()))
            size = pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at, block = 0, np.cumsum(size)
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(block, (block[at - 1] if at else 0) + _BLOCK)))
                yield batch.slice(at, stop - at), *encoder.lists(pieces.slice(at, stop - at))
                at = stop

    return blocks


def with_pieces(documents: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with (pieces, whole): the pieces or, for the few texts cut in Python, the text."""
    text = F.col("text")
    return documents.select(*keep, pieces_of(text).alias("pieces"), F.when(text.rlike(r"\p{Cn}"), text).alias("whole"))


def token_ids(documents: DataFrame, ranks_path: str = RANKS, lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """(doc_id, ids) of every document."""
    blocks = encoded_blocks(build_lexicon(documents, ranks_path, lexicon_size), ranks_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, ids in blocks(batches):
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists], names=["doc_id", "ids"])

    return with_pieces(documents, "doc_id").mapInArrow(encode, "doc_id bigint, ids array<int>")
