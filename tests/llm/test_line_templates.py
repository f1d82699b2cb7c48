import re
from collections import defaultdict

from rentweave.llm import line_templates as L

from .helpers import TEXTS, documents, plain, prose

NOTE = "Copyright holder {} all rights reserved under law number {} today"
BOILER = [(200 + i, f"{prose(200 + i, 30)}\n{NOTE.format('abcdefgh'[i] * 4, i)}\nVersion {i} of 9\n\nend {i}") for i in range(6)]
PAIR = [(300, "Only two documents hold this line of words\nmine"), (301, "Only two documents hold this line of words\nyours")]
COPY = [(310 + i, "These copies are one text and stay as they are today") for i in range(5)]


def keys(line):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
    m = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
    if len(m) < 3:
        return []
    out = [("full", len(m), *m)]
    if len(m) >= 8:
        out += [("even", len(m), *m[:2], *m[0::2]), ("odd", len(m), *m[:2], *m[1::2])]
    return out


def brute(texts, min_docs=3, keep_first=True):
    owner = {}
    for i, t in texts:
        if t is not None:
            owner[t] = min(owner.get(t, (True, 0)), (i is None, i or 0))
    held = defaultdict(set)
    for t in owner:
        for line in t.split("\n"):
            for k in keys(line):
                held[k].add(t)
    first = {k: min(ts, key=lambda t: owner[t]) for k, ts in held.items()}
    out = []
    for i, t in texts:
        if t is not None:
            t = "\n".join(x for x in t.split("\n") if not any(len(held[k]) >= min_docs and not (keep_first and first[k] == t) for k in keys(x)))
        out.append((i, t))
    return sorted(out, key=repr)


def test_matches_brute_force(spark, monkeypatch):
    texts = TEXTS + BOILER + PAIR + COPY
    docs = documents(spark, texts)
    assert plain(L.dedup_lines(docs), "doc_id", "text") == brute(texts)
    assert plain(L.dedup_lines(docs, keep_first=False), "doc_id", "text") == brute(texts, keep_first=False)
    monkeypatch.setattr(L, "FEW_TEMPLATES", 0)
    monkeypatch.setattr(L, "FEW_DOCS", 0)
    assert plain(L.dedup_lines(docs), "doc_id", "text") == brute(texts)


def test_variable_words_share_a_template_and_copies_stay(spark):
    out = {r["doc_id"]: r for r in L.dedup_lines(documents(spark, BOILER + PAIR + COPY)).collect()}
    assert "Copyright" in out[200]["text"] and all("Copyright" not in out[i]["text"] and "Version" not in out[i]["text"] for i in range(201, 206))
    assert out[300]["text"] == PAIR[0][1] and all(out[310 + i]["text"] == COPY[0][1] for i in range(5))
    assert out[201]["n_chars"] == len(out[201]["text"])


def test_no_documents(spark):
    docs = documents(spark, [])
    assert L.dedup_lines(docs).collect() == [] and L.dedup_lines(docs).columns == docs.columns


def test_texts_of_many_lines(spark):
    lines = [f"line of words {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10 % 10]} and more" for i in range(20_000)]
    texts = [(i, "\n".join([*lines, f"own words {'xyzw'[i]} only here"])) for i in range(4)]
    assert plain(L.dedup_lines(documents(spark, texts)), "doc_id", "text") == brute(texts)


def test_keys_are_made_once_a_line(spark):
    docs = documents(spark, BOILER)
    plans = []
    keep = L.staged
    try:
        L.staged = lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name)
        L.dropped_lines(docs, 3, True)
    finally:
        L.staged = keep
    assert plans[0].count("xxhash64(odd") == 1 and "text" not in plans[0].split("Generate")[0]
