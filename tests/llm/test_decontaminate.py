import hashlib
import re

from rentweave.llm import decontaminate as D

from .helpers import LONG, TEXTS, documents, plain, prose

ITEMS = [
    (1, prose(4, 80)), (2, "one"), (2, "one"), (10, None), (11, ""), (12, "?!"), (None, prose(13, 30)), (13, prose(13, 12)), (14, "never seen words at all"), (15, " ".join(LONG.split()[500:540])),
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items):
    out = []
    for doc_id, text in texts:
        w, hit, names = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(10, len(v))
            runs = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in runs:
                    hit.update(range(i, i + n))
                    if item_id is not None:
                        names.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert plain(D.contamination_digest(documents(spark), items)) == brute(TEXTS, ITEMS)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "FEW_TERMS", 0)
    monkeypatch.setattr(D, "FEW_ROWS", 0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert plain(D.contamination_digest(documents(spark), items)) == brute(TEXTS, ITEMS)


def test_dropping_keeps_clean_rows_and_columns(spark):
    docs = documents(spark)
    kept = D.drop_contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    judged = brute(TEXTS, ITEMS)
    assert kept.columns == docs.columns
    assert plain(kept, "doc_id") == sorted(((r[0],) for r in judged if not r[5]), key=repr)


def test_an_item_without_a_name_still_marks(spark):
    item = prose(77, 12)
    docs = documents(spark, [(1, prose(78, 5) + " " + item), (2, prose(79, 30))])
    got = {r["doc_id"]: r for r in D.contamination(docs, spark.createDataFrame([(None, item)], "item_id long, text string")).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (12, 0, True) and not got[2]["contaminated"]


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in D.contamination(documents(spark), items).collect()} == {0}
    assert D.contamination(documents(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_proximity(spark):
    docs = documents(spark, [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma y delta"), (3, "delta gamma beta alpha"), (4, "beta alpha gamma delta")])
    terms = D.phrase_terms(spark.createDataFrame([("alpha beta gamma delta",)], "phrase string")).cache()
    index = D.positional_index(docs, terms)
    ids = {r["row"]: r["doc_id"] for r in index.filter("term = ''").collect()}
    exact = {ids[r["row"]] for r in D.phrase_matches(index, terms).collect()}
    near = {(ids[r["row"]], r["exact"]) for r in D.phrase_matches(index, terms, slack=2).collect()}
    assert exact == {1} and {i for i, _ in near} == {1, 2, 4} and (1, True) in near and (2, True) not in near
