"""op8: language of every document."""

from rentweave.llm.common import table
from rentweave.llm.language_id import identify


def op8_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op8_language_id": (op8_language_id, None)}
