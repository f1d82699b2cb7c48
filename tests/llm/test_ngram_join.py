from collections import Counter, defaultdict

import pytest

from rentweave.llm import ngram_join as N

from .helpers import TEXTS, documents, prose

NEAR = [(100 + i, " ".join(prose(50, 200).split()[:190] + [f"w{i}"] * 3)) for i in range(12)]


def brute(texts):
    sets = [set(N.shingles(t, 5).tolist()) for _, t in texts]
    links, group = [0] * len(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                group = [group[i] if g == group[j] else g for g in group]
    members = defaultdict(list)
    for (i, _), g in zip(texts, group):
        members[g].append(i)
    name = {g: min((i for i in ids if i is not None), default=None) for g, ids in members.items()}
    return Counter((i, name[g], n) for (i, _), g, n in zip(texts, group, links)), len(members)


@pytest.mark.parametrize("block", [1024, 4])
def test_links_and_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    texts = TEXTS + NEAR
    want, groups = brute(texts)
    docs = documents(spark, texts)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in N.ngram_join(docs).collect()) == want
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == groups


def test_no_documents(spark):
    assert N.ngram_join(documents(spark, [])).collect() == [] and N.keep_one(documents(spark, [])).collect() == []


def test_banding_meets_the_recall():
    for threshold in (0.6, 0.8, 0.9):
        bands, rows = N.banding(threshold, 0.9995)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= 0.9995


def test_hashes_follow_words_not_their_spelling_around():
    assert N.shingles("A b, c!", 5).tolist() == N.shingles("a  B c", 5).tolist() != N.shingles("a b d", 5).tolist()
    assert len(N.shingles("a b c d e f g", 5)) == 3 and len(N.shingles("a b", 5)) == 1 and len(N.shingles(" .", 5)) == 0
