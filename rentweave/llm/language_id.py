"""Language identification with a string kernel.

A text is the set of its character n-grams of one to three code points (blended spectrum, presence only), each hashed to one of
``BUCKETS``. The kernel of two texts is the number of shared grams over the geometric mean of their sizes. Ridge regression runs
in the Nyström space of a fixed number of landmark texts, one output a language (+1 own, -1 others); a batch of texts is
scored by two matrix products: presence by landmarks, kernel by weights.

The model is fitted on a bounded sample of labelled rows, ``per_language`` different texts a language whatever the size of the input; every text is read whole, in
training and in prediction. Prediction is a map over rows: no shuffle, memory bounded by a batch of ``BATCH`` texts.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if no labelled row exists.
Repeated rows each get their prediction; a null id counts as empty text for the split; ties go to the language first in
the alphabet.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentweave.llm.common import small, staged

BUCKETS = 1 << 16
GRAMS = 3
BATCH = 128
FEW_MARKS = 200_000
UNKNOWN = "und"
_WORDY = re.compile(r"[^\W\d_]")


def presence(text: str, out: np.ndarray) -> None:
    """Set in ``out`` (BUCKETS of bool) the bucket of every gram of the lower-cased text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams = np.zeros(len(code), np.uint64)
    for n in range(1, GRAMS + 1):
        if len(code) < n:
            return
        grams = grams[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(1)
        out[(grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)] = True


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in _WORDY.finditer(text))


@dataclass
class Model:
    languages: list[str]
    columns: np.ndarray  # buckets that some landmark has
    landmarks: np.ndarray  # columns x landmarks, each landmark divided by the root of its size
    weights: np.ndarray  # landmarks x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        grid = np.zeros((len(texts), BUCKETS), bool)
        for row, text in zip(grid, texts):
            presence(text, row)
        return self.of_presence(grid)

    def of_presence(self, grid: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(grid.sum(axis=1), 1)).astype(np.float32)
        kernel = (grid[:, self.columns].astype(np.float32) @ self.landmarks) / sizes[:, None]
        return kernel @ self.weights


def fit(grid: np.ndarray, labels: list[str], landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """Kernel ridge regression, one output a language, on rows of gram presence."""
    languages = sorted(set(labels))
    n = len(labels)
    # Landmarks in turn from each language, so that none is without.
    rank = np.zeros(n, int)
    for name in languages:
        mine = [i for i in range(n) if labels[i] == name]
        rank[mine] = np.arange(len(mine))
    chosen = np.lexsort((np.arange(n), rank))[:landmarks]
    columns = np.flatnonzero(grid[chosen].any(axis=0))
    scaled = grid[:, columns].astype(np.float32) / np.sqrt(np.maximum(grid.sum(axis=1), 1)).astype(np.float32)[:, None]
    marks = scaled[chosen]
    base = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(base)
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = (scaled @ marks.T).astype(np.float64) @ whiten
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + ridge * n * np.eye(features.shape[1]), features.T @ target)
    return Model(languages, columns, np.ascontiguousarray(marks.T), (whiten @ solved).astype(np.float32))


def sample(docs: DataFrame, per_language: int, text: str = "text", lang: str = "lang") -> tuple[np.ndarray, list[str]]:
    """Gram presence and labels of the ``per_language`` different texts of least hash in each language (all, where there are fewer).

    Copies of one text count once, by a 64-bit hash. The driver gets 8 KB a text.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.withColumn("mark", F.xxhash64("text", F.lit(8)))
    # Spark applies the constant bound in each task, before hashes meet by language.
    least = Window.partitionBy("lang").orderBy("mark")
    marks = rows.select("lang", "mark").distinct().withColumn("k", F.row_number().over(least)).filter(F.col("k") <= per_language)
    marks = staged(marks.select("lang", "mark"), "sample")

    @F.pandas_udf(T.BinaryType())
    def packed(texts: pd.Series) -> pd.Series:
        out = []
        for value in texts:
            row = np.zeros(BUCKETS, bool)
            presence(value, row)
            out.append(np.packbits(row).tobytes())
        return pd.Series(out)

    few = rows.join(small(marks, FEW_MARKS), ["lang", "mark"], "left_semi").dropDuplicates(["lang", "mark"])
    got = few.select("lang", packed("text").alias("bits"), "mark").collect()
    if not got:
        return np.zeros((0, BUCKETS), bool), []
    got.sort(key=lambda r: (r["lang"], r["mark"]))
    grid = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in got), np.uint8).reshape(len(got), -1), axis=1).astype(bool)
    return grid, [r["lang"] for r in got]


def predictor(docs: DataFrame, model: Model | None) -> Callable[[Column], Column]:
    """A column function: text -> struct(lang, score). The model's size is fixed by landmarks and buckets."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = held.value
        for part in parts:
            names, sure = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
            known = [i for i, text in enumerate(part) if has_letter(text)] if tool is not None else []
            for a in range(0, len(known), BATCH):
                at = known[a : a + BATCH]
                out = tool.scores([part.iloc[i] for i in at])
                best = out.argmax(axis=1)
                names[at] = np.array(tool.languages, object)[best]
                sure[at] = np.clip((out[np.arange(len(at)), best].astype(np.float64) + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang": names, "score": sure})

    return predict


def learn(docs: DataFrame, fold: Column, per_language: int = 400, text: str = "text", lang: str = "lang") -> Model | None:
    """A model from the labelled rows outside ``fold`` (true: held out)."""
    grid, labels = sample(docs.filter(~fold), per_language, text, lang)
    return fit(grid, labels) if labels else None


def held_out(id_column: str = "doc_id", parts: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % parts == 0


def identify(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    fold = held_out()
    predict = predictor(docs, learn(docs, fold, per_language))
    out = docs.select("doc_id", fold.alias("held_out"), predict(F.col("text")).alias("said"))
    return out.select("doc_id", "held_out", F.col("said.lang").alias("lang_pred"), F.col("said.score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.3, per_language: int = 400) -> DataFrame:
    """The documents whose language is known with a score of ``least`` or more; their columns stay as they are."""
    predict = predictor(docs, learn(docs, held_out(), per_language))
    said = predict(F.col("text"))
    return docs.filter((said["lang"] != UNKNOWN) & (said["score"] >= least))
