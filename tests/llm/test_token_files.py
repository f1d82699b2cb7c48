import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from rentweave.llm import token_files as K
from rentweave.llm.query_token_files import VOCABULARY, op13_token_files

from .helpers import LONG, TEXTS, documents, plain

ODD = [
    (20, "\x1c\x1d x  y  \n\n z²½ 漢字 \U0001f469‍\U0001f469 "),
    (21, "I'll we've 's  \t\r\n end space wide \u0085 "),
    (22, "a" * 5000),
    (23, " " * 3000 + "x"),
    (24, "ÑÉß İ ΣΑΣ Σ ́a é ﬁ ﬁne"),
    (25, "<|endoftext|> and <|startoftext|>x </w>"),
    (-7, "below zero"),
    (26, "Don't. it's, I'LL. x's.y 9.5 a.b.c H\u0331. H\u0331o K\u0301 A.\u0301 x=\u0338 v.1,2;3:4!5? '.s a'.b end.\nNext.Line Ｆｕｌｌ. É. é."),
]


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(VOCABULARY)
    tool.encode_special_tokens = True
    return lambda t: [*tool.encode(t or "", add_special_tokens=False).ids, 1]


def expected(rows, library):
    out, start = [], 0
    for i, t in rows:
        ids = library(t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_equals_the_library_where_ids_are_unique(spark, library):
    rows = {i: t for i, t in TEXTS + ODD}
    path = K.write_tokens(documents(spark, list(rows.items())), VOCABULARY)
    got = K.with_crc32(K.documents(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert [tuple(r) for r in got.orderBy("start").collect()] == expected(in_order(rows.items()), library)


@pytest.mark.parametrize("encoding,by_chunk", [("dictionary", True), ("delta", True), ("dictionary", False)])
def test_repeated_ids_lie_side_by_side(spark, library, encoding, by_chunk):
    rows = (TEXTS + ODD) * 3
    path = K.write_tokens(documents(spark, rows), VOCABULARY, encoding=encoding, by_chunk=by_chunk)
    got = K.documents(spark, path).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert [r["doc_id"] for r in got] == [i for i, _ in in_order(rows)]
    assert plain(K.documents(spark, path), "doc_id", "ids") == sorted(((i, library(t)) for i, t in rows), key=repr)
    files = [os.path.join(path, "tokens", f) for f in os.listdir(f"{path}/tokens") if f.endswith("parquet")]
    used = set()
    for file in files:
        group = pq.ParquetFile(file).metadata
        if group.num_row_groups:
            columns = {group.row_group(0).column(i).path_in_schema: group.row_group(0).column(i) for i in range(group.num_columns)}
            used |= set(columns["ids.list.element"].encodings)
            assert "DELTA_BINARY_PACKED" in columns["first"].encodings
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in used


def test_selective_reads(spark, library):
    rows = [(i, f"word {i} " + "and more " * (i % 50)) for i in range(3000)]
    path = K.write_tokens(documents(spark, rows), VOCABULARY, page_rows=50)
    stream = [i for _, t in rows for i in library(t)]
    for a, b in [(0, 1), (0, len(stream)), (1000, 1001), (7, 40_000), (len(stream) - 3, len(stream) + 100), (len(stream), len(stream) + 5), (5, 5)]:
        got = K.window(spark, path, a, b).orderBy("at").collect()
        assert sum((r["ids"] for r in got), []) == stream[a:b]
        assert not got or got[0]["at"] == a
    few = K.documents(spark, path, 100, 102)
    assert [(r["doc_id"], r["ids"]) for r in few.orderBy("doc_id").collect()] == [(i, library(t)) for i, t in rows[100:103]]
    told = few.select("doc_id", "start", "n_tokens")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0] and "GreaterThanOrEqual(_id,100)" in plan


def test_empty_table_and_clashing_names(spark):
    path = K.write_tokens(documents(spark, []), VOCABULARY)
    assert K.documents(spark, path).collect() == [] and K.window(spark, path, 0, 10).collect() == []
    clash = documents(spark, [(1, "one two")]).selectExpr("doc_id AS part", "text AS ids", "doc_id AS first", "text AS _text")
    path = K.write_tokens(clash, VOCABULARY, text="ids", id_column="part")
    assert K.documents(spark, path, id_column="part").select("part", "start", "n_tokens").collect() == [(1, 0, 3)]


def test_one_long_text_without_blanks_beside_others(spark, library):
    rows = [(1, "x" * 30_000), (2, LONG), (3, "x" * 30_000)]
    path = K.write_tokens(documents(spark, rows), VOCABULARY)
    assert plain(K.documents(spark, path), "doc_id", "ids") == [(i, library(t)) for i, t in rows]


def test_query_over_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables are not there")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = op13_token_files(spark, sf).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32")
    assert [tuple(r) for r in got.collect()] == expected(rows, library)


def test_memory_of_chunks_starts_anew(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(K, "KEPT", 5)
    tool = K.Encoder(open(VOCABULARY, "rb").read(), 1, True)
    for texts in (["one two three four", "five six"], ["seven one", ""], ["a b c d e f g h one"], ["one a two b one", "c"]):
        ids, sizes = tool.texts(pa.array(texts))
        want = [library(t) for t in texts]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]



def test_words_of_a_to_z_go_to_the_model_alone(library):
    """The same ids as from the whole tool, which normalizes and splits every text, at a third of its time."""
    tool = K.Encoder(open(VOCABULARY, "rb").read(), 1, True)
    asked = []

    class Watched:
        def __getattr__(self, name):
            return lambda texts, **more: asked.extend(texts) or getattr(tool_itself, name)(texts, **more)

    tool_itself, tool.tool = tool.tool, Watched()
    texts = ["plain words only theeeestion zqxj", "more of it\nand Capitals Too"]
    ids, sizes = tool.texts(pa.array(texts))
    assert not asked and [ids[b - n : b].tolist() for b, n in zip(np.cumsum(sizes), sizes)] == [library(t) for t in texts]
    odd = ["it's 9,5 É é İx ΣΑΣ", "H̱o Áb Plain"]
    ids, sizes = tool.texts(pa.array(odd))
    assert asked and [ids[b - n : b].tolist() for b, n in zip(np.cumsum(sizes), sizes)] == [library(t) for t in odd]
