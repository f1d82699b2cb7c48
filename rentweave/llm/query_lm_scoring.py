"""op10: language-model score of every document."""

import public_tokenizers

from rentweave.llm.common import table
from rentweave.llm.lm_scoring import lm_scores


def op10_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op10_lm_scoring": (op10_lm_scoring, None)}
