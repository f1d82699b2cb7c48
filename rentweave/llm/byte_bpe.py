"""Byte-level BPE encoding and decoding by segment trees.

A piece of text is a row of byte positions. The leaf of a live position holds the rank of the pair that starts there, and
inner nodes hold the leftmost minimum, so the root names the next merge. A merge changes three leaves: the merged
position, its live neighbour on the left, and the one swallowed on the right; each is carried up in a logarithmic number of
steps. All pieces of one length class are worked in step as rows of one numpy array, and every distinct piece of a
batch is encoded once.

The split into pieces is done by Spark (``regexp_extract_all``); the rest runs over Arrow buffers. Nothing
is shuffled, memory is bounded by one slice of a batch or by the longest single text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentweave.llm.common import small_batches

#: Text worked at a time within an Arrow batch, in bytes; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20
NONE = np.int64(1) << 62


def read_ranks(raw: bytes, size: int | None = None) -> list[bytes]:
    """Tokens by rank from a rank file: base64 token, space, rank. ``size`` keeps the ranks below it."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}
    size = len(ranks) if size is None else size
    return [ranks[i] for i in range(size)]


class Codec:
    """Merge tables of a vocabulary, whole-array encoder and decoder."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        at = {token: i for i, token in enumerate(tokens)}
        self.byte_id = np.array([at[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in at.items():
            for cut in range(1, len(token)):
                left, right = at.get(token[:cut]), at.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self._hash(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.vocabulary = pa.array(tokens, pa.binary())

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: a slot for each pair, found in a few whole-array probes."""
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        left = np.arange(len(keys))
        slot, self.probes = self._slot(keys), 0
        while len(left):
            self.probes += 1
            here = slot[left]
            free = self.keys[here] == -1
            _, first = np.unique(here[free], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the two don't merge or a side is missing (-1)."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left * self.size + right)
        slot, out = self._slot(keys), np.full(len(keys), NONE, np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def _merge(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces of at most ``width`` (a power of two) bytes; ids in row order, and their counts."""
        n, bits = len(starts), width.bit_length() - 1
        column = np.arange(width)
        live = column[None, :] < lens[:, None]
        ids = np.full((n, width), -1, np.int64)
        ids[live] = self.byte_id[data[ragged(starts, lens)]]
        ids = ids.ravel()
        # The neighbour after the last position is `width`, the one before the first is -1.
        after = np.minimum(column[None, :] + 1, np.where(lens, lens, 1)[:, None]).astype(np.int32)
        after[after == lens[:, None]] = width
        after, before = after.ravel(), np.tile((column - 1).astype(np.int32), n)
        tree = np.full((n, 2 * width), NONE, np.int64)
        right = np.full((n, width), -1, np.int64)
        right[:, :-1] = ids.reshape(n, width)[:, 1:]
        rank = self.pair_rank(ids, right.ravel()).reshape(n, width)
        tree[:, width:] = np.where(rank < NONE, (rank << bits) | column[None, :], NONE)
        for level in range(bits - 1, -1, -1):
            low = 1 << level
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        flat, rows = tree.ravel(), np.arange(n)
        while True:
            root = flat[rows * (2 * width) + 1]
            rows, root = rows[root < NONE], root[root < NONE]
            if not len(rows):
                break
            base, at, merged = rows * width, root & (width - 1), root >> bits
            gone = after[base + at].astype(np.int64)
            then = after[base + gone].astype(np.int64)
            ids[base + at], ids[base + gone] = merged, -1
            after[base + at] = then
            inner = then < width
            before[(base + then)[inner]] = at[inner]
            prior = before[base + at].astype(np.int64)
            follower = np.where(inner, ids[base + np.where(inner, then, 0)], -1)
            leader = np.where(prior >= 0, ids[base + np.maximum(prior, 0)], -1)
            ranks = self.pair_rank(np.concatenate([merged, leader]), np.concatenate([follower, merged]))
            value = np.where(ranks < NONE, (ranks << bits) | np.concatenate([at, np.maximum(prior, 0)]), NONE)
            top = rows * (2 * width) + width
            has = prior >= 0
            leaf = np.concatenate([top + gone, top + at, (top + prior)[has]])
            flat[leaf] = np.concatenate([np.full(len(rows), NONE), value[: len(rows)], value[len(rows) :][has]])
            home = np.concatenate([rows, rows, rows[has]]) * (2 * width)
            node = leaf - home
            for _ in range(bits):
                node >>= 1
                child = home + 2 * node
                flat[home + node] = np.minimum(flat[child], flat[child + 1])
        grid = ids.reshape(n, width)
        kept = grid >= 0
        return grid[kept].astype(np.int32), kept.sum(axis=1)

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every piece (a string or binary array without nulls), one after the other, and their counts."""
        raw = pieces.cast(pa.large_binary())
        n = len(raw)
        whole = pc.index_in(raw.cast(pa.binary()), value_set=self.vocabulary)
        whole = whole.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        starts, lens = offsets[:-1], np.diff(offsets)
        counts = np.where(whole >= 0, 1, 0).astype(np.int64)
        rest = np.flatnonzero((whole < 0) & (lens > 0))
        classes = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lens[rest], 2))).astype(np.int64))
        done = []
        for width in np.unique(classes):
            mine = rest[classes == width]
            step = max(1, (1 << 20) // int(width))
            for i in range(0, len(mine), step):
                part = mine[i : i + step]
                ids, count = self._merge(data, starts[part], lens[part], int(width))
                counts[part] = count
                done.append((part, ids, count))
        out_starts = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(out_starts[-1], np.int32)
        single = np.flatnonzero(whole >= 0)
        out[out_starts[single]] = whole[single]
        for part, ids, count in done:
            out[ragged(out_starts[part], count)] = ids
        return out, counts

    def encode_texts(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of pieces, and the number of each row's ids. Each distinct piece is encoded once."""
        flat = pieces.flatten()
        coded = flat.dictionary_encode()
        ids, counts = self.encode_pieces(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        per_piece = counts[index] if len(index) else np.zeros(0, np.int64)
        out = ids[ragged(starts[index], per_piece)] if len(index) else np.zeros(0, np.int32)
        rows = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).fill_null(0).to_numpy(zero_copy_only=False))])
        ends = np.concatenate([[0], np.cumsum(per_piece)])
        return out, np.diff(ends[rows.astype(np.int64)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, one after the other."""
        return self.bytes[ragged(self.starts[ids], self.lens[ids])]



def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


_CODECS: dict[bytes, Codec] = {}


def codec(raw: bytes, size: int | None = None) -> Codec:
    """A vocabulary's tables, made once for each Python worker."""
    key = hashlib.sha256(raw).digest() + str(size).encode()
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(raw, size))
    return _CODECS[key]


def slices(lengths: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` together; a larger row is a run of its own."""
    start, held = 0, 0
    for i, size in enumerate(lengths.tolist()):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(lengths):
        yield start, len(lengths)


def java_pattern(pattern: str) -> str:
    """The split pattern for Spark's regular expressions: white space as Unicode has it, like the tokenizer's own."""
    return "(?U)" + pattern


def with_pieces(df: DataFrame, pattern: str, text: str = "text", into: str = "_pieces") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(into, F.regexp_extract_all(body, F.lit(java_pattern(pattern)), F.lit(0)))


def byte_bpe(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Encode every text and decode the ids again: (id, ids array<int>, decoded binary), one row for each input row.

    ``vocabulary`` is the path of a rank file on the driver; its bytes (a fixed file, below a megabyte) travel with the tasks.
    Null and empty texts give no ids. Repeated rows stay. Other columns are left behind, whatever their names.
    """
    raw = open(vocabulary, "rb").read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(raw)
        for key, ids, counts in encoded(tool, batches):
            lens = np.add.reduceat(np.append(tool.lens[ids], 0), np.minimum(np.cumsum(counts) - counts, len(ids)))
            lens = np.where(counts > 0, lens, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    key,
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids)),
                    binary_rows(tool.decode(ids), lens),
                ],
                ["_key", "ids", "decoded"],
            )

    small_batches(df.sparkSession)
    kind = df.schema[id_column].dataType
    schema = T.StructType(
        [T.StructField("_key", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    )
    out = with_pieces(df.select(F.col(id_column).alias("_key"), F.col(text).alias("text")), pattern).select("_key", "_pieces")
    return out.mapInArrow(run, schema).withColumnRenamed("_key", id_column)


def binary_rows(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encoded(tool: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, ids and counts of ids for slices of (key, pieces) batches."""
    for batch in batches:
        pieces = batch.column(1)
        sizes = pc.list_value_length(pieces).fill_null(0).to_numpy(zero_copy_only=False)
        # A piece with its offset takes about eight bytes and more in the buffers.
        for a, b in slices(sizes * 8):
            ids, counts = tool.encode_texts(pieces.slice(a, b - a))
            yield batch.column(0).slice(a, b - a), ids, counts


def token_digests(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Digests of what ``byte_bpe`` gives: n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256."""
    out = byte_bpe(df, vocabulary, pattern, text, id_column)
    return out.select(
        id_column,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
