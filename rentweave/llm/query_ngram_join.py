"""op9: groups of near-duplicate documents."""

from rentweave.llm.common import table
from rentweave.llm.ngram_join import ngram_join


def op9_ngram_jaccard_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "copy_of", "class_id", "n_links")


QUERIES = {"op9_ngram_jaccard_join": (op9_ngram_jaccard_join, None)}
