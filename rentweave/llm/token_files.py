"""Token ids as Parquet list columns.

A token set is a folder with two tables. ``tokens`` has one row a document in ascending id order: (part, _id, first, stop, ids), where part is
the number of the file's task and [first, stop) the place of the document's ids among those of its part. ``index`` has one row a
part: (part, base, n_tokens, n_docs), base being the number of ids in all parts before. The global start of a document is base + first, so no
second pass over the ids is needed to number them.

Ids are dictionary encoded (a page of the dictionary holds the whole vocabulary) or delta encoded; the other columns, which rise, are always
delta encoded. Row groups and pages are kept small, and Parquet writes a column index for each page, so that

* figures of documents (`documents` without ids) read no byte of the list column,
* some documents (`documents` by id) and a stretch of the token stream (`window`) read only the pages that can hold them.

Texts are dealt by range of (id, hash of the text), so a third of all rows under one id are spread too, and no task needs more than one slice of texts and its
own file. Equal rows are dealt by their place in the input.

Tokens come from the tokenizers library, asked once for each different chunk between blanks. That is exact for tokenizers that lower the text, split letters from marks and
never let a piece cross a blank (``BLANKS`` lists what counts as one here); for others pass ``by_chunk=False``, which hands whole texts to the library.

Defined results: null and empty texts have the end id alone; a null id comes first; documents of one id are ordered by a hash of their text; repeated
rows are documents of their own; an empty table gives empty tables. Control tokens' strings inside texts are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentweave.llm.byte_bpe import ragged, slices
from rentweave.llm.common import small, small_batches
from rentweave.session import checkpoint_root

BLANKS = " \n"
#: Parts whose index rows (40 bytes each) may be broadcast.
FEW_PARTS = 1_000_000
#: Chunks, and ids of chunks, that a worker keeps before it starts anew.
KEPT, KEPT_IDS = 600_000, 4 << 20
#: Bytes of texts encoded together; a longer text goes alone.
GATHERED = 6 << 20
#: Chunks handed to the library as one text.
JOINED = 100
#: Words that tell whether a tokenizer hands words of a-z to its model unchanged.
PROBES = [*"abcdefghijklmnopqrstuvwxyz", "thequickbrownfoxjumpsoverthelazydog", "s", "ll", "re"]


class Encoder:
    """Ids of texts, with a memory of the chunks seen so far."""

    def __init__(self, raw: bytes, end: int, by_chunk: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(raw.decode("utf-8"))
        self.tool.encode_special_tokens = True
        self.end, self.by_chunk = end, by_chunk
        suffix = json.loads(raw)["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            vocabulary = self.tool.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        # Where normalizing and splitting leave words of a-z as they are, the library's model may be asked for them itself.
        self.model = self.tool.model
        self.direct = self.ends is not None and all([t.id for t in self.model.tokenize(w)] == self.tool.encode(w, add_special_tokens=False).ids for w in PROBES)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.lens, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(8192, np.int32), 0

    def _renew(self, chunks: list[str]) -> None:
        """Keep only those of the given chunks that are known: the frequent ones are among them."""
        kept = [x for x in chunks if x in self.place]
        at = np.fromiter((self.place[x] for x in kept), np.int64, len(kept))
        lens = self.lens[at]
        ids = self.ids[ragged(self.starts[at], lens)]
        self._forget()
        self._keep(kept, ids, lens)

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks. Words of a-z go to the library's model one by one, which costs a third; of others it takes JOINED as one text. Chunks of letters alone are one word each, whose last id is one that ends
        words; for others the offsets that the library gives tell which chunk an id belongs to."""
        plain, words, rest = [], [], chunks
        if self.ends is not None:
            rest = []
            for x in chunks:
                if x.isalpha() and "\u0130" not in x:  # its lower case has a mark
                    (plain if self.direct and x.isascii() and x.islower() else words).append(x)
                else:
                    rest.append(x)
        found, lens = array("i"), array("q")
        for x in plain:
            got = self.model.tokenize(x)
            lens.append(len(got))
            found.extend([t.id for t in got])
        self._keep(plain, np.array(found, np.int32), np.array(lens, np.int64))
        for some, by_end in ((words, True), (rest, False)):
            groups = [some[a : a + JOINED] for a in range(0, len(some), JOINED)]
            encode = self.tool.encode_batch_fast if by_end else self.tool.encode_batch
            for a in range(0, len(groups), 64):
                texts = [" ".join(g) for g in groups[a : a + 64]]
                for part, got in zip(groups[a : a + 64], encode(texts, add_special_tokens=False)):
                    ids = np.array(got.ids, np.int32)
                    if by_end:
                        lens = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
                        assert len(lens) == len(part), "a chunk of letters is not one word"
                    else:
                        stops = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
                        begins = np.fromiter((begin for begin, _ in got.offsets), np.int64, len(ids))
                        lens = np.bincount(np.searchsorted(stops, begins, "right"), minlength=len(part))
                    self._keep(part, ids, lens)

    def _keep(self, chunks: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        at = len(self.place)
        while at + len(chunks) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at : at + len(chunks)], self.lens[at : at + len(chunks)] = self.used + np.cumsum(lens) - lens, lens
        self.place.update(zip(chunks, range(at, at + len(chunks))))
        self.used += len(ids)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each text's number of ids); every text ends with the end id."""
        if not self.by_chunk:
            got = [[*x.ids, self.end] for x in self.tool.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in got for i in ids], np.int32), np.array([len(ids) for ids in got], np.int64)
        # A mark behind a letter or digit begins a piece of its own, so a blank before it changes no id and makes fewer chunks. Capitals are
        # lowered first where none is followed by a combining mark, with which it might be composed.
        texts = pc.replace_substring_regex(texts, r"([A-Za-z0-9])([.,;:!?])", r"\1 \2")
        bound = pc.match_substring_regex(texts, r"[A-Z]\p{M}")
        texts = pc.if_else(bound, texts, pc.ascii_lower(texts))
        for blank in BLANKS[1:]:
            texts = pc.replace_substring(texts, blank, BLANKS[0])
        parts = pc.split_pattern(texts, BLANKS[0])
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        # Numpy makes the strings several times faster than to_pylist; most of what is left here are look-ups, so they run without Python code.
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = list(filterfalse(self.place.__contains__, chunks))
        if len(self.place) + len(fresh) > KEPT or self.used > KEPT_IDS:
            self._renew(chunks)
        self._learn(fresh)
        known = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        places = known[coded.indices.to_numpy()] if len(chunks) else np.zeros(0, np.int64)
        lens = self.lens[places]
        body = self.ids[ragged(self.starts[places], lens)]
        # Ids of a text, then the end id behind its last chunk.
        ends = np.cumsum(np.add.reduceat(np.append(lens, 0), np.cumsum(counts) - counts)) if len(counts) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([[0], ends])) + 1
        return np.insert(body, ends, self.end).astype(np.int32), sizes.astype(np.int64)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(raw: bytes, end: int, by_chunk: bool) -> Encoder:
    """One encoder for each Python worker."""
    key = (hashlib.sha256(raw).digest(), end, by_chunk)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(raw, end, by_chunk)
    return _ENCODERS[key]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Two columns of small batches as larger arrays, of which more repeat their chunks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHERED:
            yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
            held = []
    if held:
        yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    path: str | None = None,
    end: int = 1,
    encoding: str = "dictionary",
    row_group_mb: int = 16,
    page_kb: int = 128,
    page_rows: int = 1000,
    by_chunk: bool = True,
    text: str = "text",
    id_column: str = "doc_id",
) -> str:
    """Write the token set of all documents and return its folder (a fresh one in the shared checkpoint folder, unless given).

    ``vocabulary`` is a tokenizer file on the driver; its bytes (a fixed file of a few megabytes) travel with the tasks.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_root(spark).rstrip('/')}/llm/tokens-{uuid.uuid4().hex}"
    with open(vocabulary, "rb") as file:
        raw = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, base = encoder(raw, end, by_chunk), TaskContext.get().partitionId(), 0
        for keys, texts in gathered(batches):
            for a, b in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), GATHERED):
                ids, sizes = tool.texts(texts.slice(a, b - a))
                stops = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a, part, np.int32)),
                        keys.slice(a, b - a),
                        pa.array(base + stops - sizes),
                        pa.array(base + stops),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(ids)),
                    ],
                    ["part", "_id", "first", "stop", "ids"],
                )
                base += int(stops[-1])

    small_batches(spark)
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("_row"))
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("_id", docs.schema[id_column].dataType),
            T.StructField("first", T.LongType()),
            T.StructField("stop", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )
    out = dealt.sortWithinPartitions(*order, "_text").select("_id", "_text").mapInArrow(run, schema)
    (
        out.write.option("compression", "snappy")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_mb << 20)
        .option("parquet.page.size", page_kb << 10)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .parquet(f"{path}/tokens")
    )
    parts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.max("stop").alias("n_tokens"), F.count("*").alias("n_docs"))
    # One row a part, so this single window is as small as the list of files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "n_tokens", "n_docs").write.parquet(f"{path}/index")
    return path


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def documents(spark: SparkSession, path: str, low=None, high=None, id_column: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of all documents, or of those with an id in [low, high]. Select columns to leave the ids unread."""
    rows = spark.read.parquet(f"{path}/tokens")
    if low is not None:
        rows = rows.filter(F.col("_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("_id") <= high)
    rows = rows.join(small(_index(spark, path).select("part", "base"), FEW_PARTS), "part")
    return rows.select(F.col("_id").alias(id_column), (F.col("base") + F.col("first")).alias("start"), (F.col("stop") - F.col("first")).alias("n_tokens"), "ids")


def window(spark: SparkSession, path: str, start: int, stop: int, id_column: str = "doc_id") -> DataFrame:
    """(id, at, ids): what of the token stream lies in [start, stop), by document; ``at`` is the place of the first id in the stream.

    The first and last part come from the index as one row; bounds on parts and places are plain comparisons, which Parquet checks by
    row group and page.
    """
    index = _index(spark, path)
    inside = index.filter((F.col("base") < stop) & (F.col("base") + F.col("n_tokens") > start))
    edge = inside.agg(F.min(F.struct("part", "base")).alias("a"), F.max(F.struct("part", "base")).alias("b")).first()
    rows = spark.read.parquet(f"{path}/tokens")
    if edge["a"] is None:
        rows = rows.filter(F.lit(False))
    else:
        (first, low), (last, high) = edge["a"], edge["b"]
        rows = rows.filter((F.col("part") >= first) & (F.col("part") <= last))
        rows = rows.filter((F.col("part") > first) | (F.col("stop") > start - low)).filter((F.col("part") < last) | (F.col("first") < stop - high))
    rows = rows.join(small(index.select("part", "base"), FEW_PARTS), "part")
    begin = F.col("base") + F.col("first")
    skip = F.greatest(F.lit(0).cast("long"), F.lit(start) - begin)
    size = F.least(F.col("base") + F.col("stop"), F.lit(stop)) - begin - skip
    return rows.select(F.col("_id").alias(id_column), (begin + skip).alias("at"), F.slice("ids", (skip + 1).cast("int"), size.cast("int")).alias("ids"))


def with_crc32(rows: DataFrame) -> DataFrame:
    """The rows with ``ids_crc32`` in place of ``ids``: the unsigned checksum of the ids as little-endian unsigned 32-bit integers."""
    names = [n for n in rows.columns if n != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            offsets = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], [*names, "ids_crc32"])

    small_batches(rows.sparkSession)
    schema = T.StructType([rows.schema[n] for n in names] + [T.StructField("ids_crc32", T.LongType())])
    return rows.select(*names, "ids").mapInArrow(run, schema)
