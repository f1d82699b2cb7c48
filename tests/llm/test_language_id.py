import random
import zlib

import numpy as np

from rentweave.llm import language_id as I

from .helpers import TEXTS, documents

WORDS = {"en": "the and thing with ion shall", "de": "der und nicht ein keit schön", "es": "que los ción por señor llama"}


def corpus(n=240):
    rng = random.Random(3)
    return [(i, " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "o"]) for _ in range(rng.randint(6, 60))), lang) for i in range(n) for lang in [list(WORDS)[i % 3]]]


def test_held_out_accuracy_and_unknown_texts(spark):
    rows = corpus()
    odd = [(10_000 + k, t, None) for k, (_, t) in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, lang, "lang") for i, t, lang in rows + odd], "doc_id long, text string, lang string, lang_pred string")
    got = {r["doc_id"]: r for r in I.identify(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(lang, got[i]["lang_pred"]) for i, _, lang in rows if got[i]["held_out"]]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)
    for i, t, _ in odd:
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))


def test_keeping_leaves_columns_and_known_texts(spark):
    docs = documents(spark, [(i, t) for i, t, _ in corpus()] + TEXTS).withColumnRenamed("lang", "old").selectExpr("*", "CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'es' END AS lang")
    kept = I.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 20 AND doc_id < 240").count() == 220
    assert kept.filter("text IS NULL OR trim(text) = ''").count() == 0


def test_nothing_to_learn_from(spark):
    got = I.identify(documents(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert len(got) == len(TEXTS) and {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert I.identify(documents(spark, [])).collect() == []


def test_kernel_counts_shared_grams():
    texts = [t for _, t, _ in corpus(30)]
    grid = np.zeros((30, I.BUCKETS), bool)
    for row, t in zip(grid, texts):
        I.presence(t, row)
    model = I.fit(grid, [lang for *_, lang in corpus(30)], landmarks=12)
    grams = [{t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    for a in range(5):
        for b in range(5):
            kernel = (grid[a] & grid[b]).sum() / np.sqrt(grid[a].sum() * grid[b].sum())
            exact = len(grams[a] & grams[b]) / np.sqrt(len(grams[a]) * len(grams[b]))
            assert abs(kernel - exact) < 0.03
    assert model.landmarks.shape[1] == 12 and np.allclose(model.scores(texts[:4]), model.of_presence(grid[:4]))


def test_sample_has_the_number_asked_for_whatever_the_size_of_a_language(spark, monkeypatch):
    # A bar by the number of rows lets half of the texts asked for through here, as every text comes twice.
    rows = [(i, f"text {i % 3000}", "en" if i % 3000 % 10 else "de") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for few in (I.FEW_MARKS, 0):
        monkeypatch.setattr(I, "FEW_MARKS", few)
        grid, labels = I.sample(docs, 250)
        assert (labels.count("en"), labels.count("de"), len(grid)) == (250, 250, 500)
    assert sorted(set(I.sample(docs, 400)[1])) == ["de", "en"] and I.sample(docs, 400)[1].count("de") == 300
