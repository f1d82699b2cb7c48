"""op13: token ids of every document, written to Parquet and read back."""

import public_tokenizers

from rentweave.llm.common import table
from rentweave.llm.token_files import documents, with_crc32, write_tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op13_token_files(spark, sf_dir):
    path = write_tokens(table(spark, sf_dir, "documents"), VOCABULARY)
    return with_crc32(documents(spark, path))


QUERIES = {"op13_token_files": (op13_token_files, None)}
