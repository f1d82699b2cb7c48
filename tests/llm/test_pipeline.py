"""Every stage on its own input, against what it must keep."""

import subprocess
import sys

import public_tokenizers as P

import corpus_pipeline
from rentweave.llm.common import staged

from .test_decontaminate import words
from .test_line_templates import brute as lines_left
from .test_ngram_join import brute as near_groups

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        out[name] = (sorted((r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()), docs)
        if name != "encode":
            assert docs.columns == columns

    def rows(name):
        return sorted((r["doc_id"], r["text"]) for r in out[name][1].select("doc_id", "text").collect())

    assert rows("language") == [x for x in out["language"][0] if any(c.isalpha() for c in x[1] or "")]
    assert sorted(rows("line_dedup"), key=repr) == lines_left(out["line_dedup"][0])
    assert len(rows("near_duplicates")) == near_groups(out["near_duplicates"][0])[1]
    runs = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        runs |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    clean = []
    for doc_id, text in out["decontaminate"][0]:
        w = words(text)
        if not any(tuple(w[i : i + 10]) in runs for i in range(len(w))):
            clean.append((doc_id, text))
    assert rows("decontaminate") == clean
    assert rows("encode") == clean


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "text"] and got.filter("size(ids) <> n_tokens").count() == 0


def test_the_rest_imports_without_this_folder(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('rentweave.llm', 'corpus_pipeline'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and len(e.queries()) > 90\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], check=True, timeout=120)
    assert P.PATTERN
