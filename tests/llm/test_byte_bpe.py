import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from rentweave.llm import byte_bpe as B

from .helpers import TEXTS, documents, plain

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = [(20, "\x1c\x1d x  y  \n\n z²½ 漢字 \U0001f469‍\U0001f469 "), (21, "I'll we've 's  \t\r\n end   "), (22, "a" * 5000), (23, " " * 3000 + "x"), (24, "ñÉß" * 700)]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library_and_decodes_to_the_text(spark, library):
    texts = TEXTS + ODD
    want = []
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert plain(B.token_digests(documents(spark, texts), PATH, P.PATTERN)) == sorted(want, key=repr)


def test_no_documents(spark):
    assert B.token_digests(documents(spark, []), PATH, P.PATTERN).collect() == []


def test_merges_match_a_plain_loop_on_a_cut_vocabulary():
    tool = B.codec(open(PATH, "rb").read(), 700)
    tokens = B.read_ranks(open(PATH, "rb").read(), 700)
    rank = {t: i for i, t in enumerate(tokens)}

    def slow(piece):
        if piece in rank:
            return [rank[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
            if not pairs:
                return [rank[p] for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = np.random.default_rng(1)
    pieces = [bytes(rng.choice(list(b"aehinorst "), rng.integers(0, 40))) for _ in range(300)] + [b"the" * 100, b"\xff\x00"]
    ids, counts = tool.encode_pieces(pa.array(pieces, pa.binary()))
    want = [slow(p) for p in pieces]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert tool.decode(ids).tobytes() == b"".join(pieces)
