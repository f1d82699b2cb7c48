"""op4: secrets in every document."""

from pyspark.sql import functions as F

from rentweave.llm.common import hex_digest, table
from rentweave.llm.secret_scan import find_secrets


def op4_secret_scans(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def told(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        hex_digest(told("base")).alias("base_sha256"),
        told("spans").alias("spans"),
        count("model").alias("n_model"),
    )


QUERIES = {"op4_secret_scans": (op4_secret_scans, None)}
