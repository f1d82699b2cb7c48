"""op6: byte-level BPE of every document."""

import public_tokenizers

from rentweave.llm.byte_bpe import token_digests
from rentweave.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_byte_bpe(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


QUERIES = {"op6_byte_bpe": (op6_byte_bpe, None)}
