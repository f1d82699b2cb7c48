"""Secret scans: fixed patterns, and a character convolutional network over every further candidate.

One pass over the texts finds the pattern matches (base spans, always kept) and the candidates: runs of twelve or more key
characters with a digit among them. A candidate that overlaps a base span is a labelled finding, another one a labelled
non-finding. The network reads a window of the candidate and the text around it; it is trained in numpy, first on the driver with a bounded
sample of distinct windows (SAMPLE of each label, least by hash), the text before the candidate blanked in half of them, so that it learns
what keys look like and not just what stands before the known ones. A quarter of the windows is set apart to calibrate its
output (Platt scaling) and to set the threshold: between the highest one that still finds RECALL of the set-apart findings and the
next non-finding below it.

Where there are more windows than that, the sample only starts the network: every distinct window outside the quarter, dealt to shards of
SHARD, is gone through once more, both labels weighing the same, and Spark averages what the shards come to. All set-apart windows then count in the
calibration and the threshold, as numbers of windows by label and output in steps of 1 / STEPS.

Every candidate of every text is scored; those at the threshold become spans of kind ``model``. Both passes are maps; only the
distinct windows are shuffled. Without both labels on both sides there is no model and nothing is added.

Defined results: a null text is empty and has no spans; offsets are code points, ends exclusive; repeated rows each get their row; nothing is
cut off from long texts. A window holds the first and last parts of a candidate longer than INSIDE.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentweave.llm.common import small_batches, staged

#: The patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
DIGIT = re.compile(r"[0-9]")

BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
SAMPLE, RECALL = 2000, 0.98
SHARD, STEPS = 1 << 14, 100
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
FOUND = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("window", T.BinaryType()), T.StructField("known", T.BooleanType())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches by start, then kind."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(kind, m.start(), m.end()) for kind, p in (("access", ACCESS), ("hex", HEX)) for m in p.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def window(text: str, start: int, stop: int) -> bytes:
    """WIDTH codes: 1 to 127 for ASCII, 128 for others, 0 where there is nothing."""

    def codes(part: str) -> bytes:
        return bytes(min(ord(c), 128) for c in part)

    inside = text[start:stop] if stop - start <= INSIDE else text[start : start + INSIDE // 2] + text[stop - INSIDE // 2 : stop]
    return (
        codes(text[max(0, start - BEFORE) : start]).rjust(BEFORE, b"\0") + codes(inside).ljust(INSIDE, b"\0") + codes(text[stop : stop + AFTER]).ljust(AFTER, b"\0")
    )


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, bytes, bool]]:
    out, at = [], 0
    reach = np.maximum.accumulate([s[2] for s in spans]) if spans else []
    for m in CANDIDATE.finditer(text):
        if DIGIT.search(m[0]):
            a, b = m.span()
            # The spans that start before the candidate ends; one of them reaches into it or none does.
            while at < len(spans) and spans[at][1] < b:
                at += 1
            out.append((a, b, window(text, a, b), bool(at and reach[at - 1] > a)))
    return out


PARAMS = ("embed", "conv", "bias", "dense")


@dataclass
class Network:
    """Embedding, one convolution, largest and mean response, one output; then Platt scaling and the threshold."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    TAPS = 5

    @classmethod
    def fresh(cls, rng: np.random.Generator, depth: int = 8, filters: int = 24) -> Network:
        return cls(
            rng.normal(0, 0.3, (129, depth)).astype(np.float32),
            rng.normal(0, 0.2, (cls.TAPS * (depth + 1), filters)).astype(np.float32),
            np.zeros(filters, np.float32),
            np.zeros(2 * filters + 1, np.float32),
        )

    def params(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in PARAMS]

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        n = len(codes)
        inside = np.zeros((n, WIDTH, 1), np.float32)
        inside[:, BEFORE : BEFORE + INSIDE] = (codes[:, BEFORE : BEFORE + INSIDE, None] > 0).astype(np.float32)
        x = np.concatenate([self.embed[codes] * (codes[:, :, None] > 0), inside], axis=2)
        places = WIDTH - self.TAPS + 1
        cols = np.concatenate([x[:, t : t + places] for t in range(self.TAPS)], axis=2)
        act = np.maximum(cols @ self.conv + self.bias, 0)
        top = act.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(axis=1), np.ones((n, 1), np.float32)], axis=1)
        return pooled @ self.dense, (codes, cols, act, top, pooled)

    def gradients(self, seen: tuple, error: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss, for embed, conv, bias and dense; error is the loss's slope at the outputs."""
        codes, cols, act, top, pooled = seen
        n, places, filters = act.shape
        error = (error / n).astype(np.float32)
        back = error[:, None] * self.dense[None, :-1]
        grad = np.repeat(back[:, None, filters:] / places, places, axis=1)
        np.put_along_axis(grad, top[:, None], np.take_along_axis(grad, top[:, None], 1) + back[:, None, :filters], 1)
        grad *= act > 0
        conv = np.tensordot(cols, grad, axes=([0, 1], [0, 1]))
        wide = grad @ self.conv.T
        depth = self.embed.shape[1]
        embed = np.zeros_like(self.embed)
        for t in range(self.TAPS):
            part = wide[:, :, t * (depth + 1) : t * (depth + 1) + depth]
            np.add.at(embed, codes[:, t : t + places], part)
        embed[0] = 0
        return [embed, conv, grad.sum(axis=(0, 1)), pooled.T @ error]

    def chance(self, codes: np.ndarray) -> np.ndarray:
        out = [self.forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)]
        logit = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit + self.scale[1], -30, 30)))


def blanked(codes: np.ndarray) -> np.ndarray:
    out = codes.copy()
    out[:, :BEFORE] = 0
    return out


def descend(net: Network, batches: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], rng: np.random.Generator, rate: float) -> None:
    """Adam over batches of windows, labels and weights, the text before half of the windows blanked; changes the network."""
    params = net.params()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step, (batch, target, weight) in enumerate(batches, 1):
        hide = rng.random(len(batch)) < 0.5
        batch[hide] = blanked(batch[hide])
        logit, seen = net.forward(batch)
        for k, g in enumerate(net.gradients(seen, weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target))):
            g = g + 2e-3 * params[k]  # weight decay keeps the log odds of a small sample finite
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)


def fit(own: np.ndarray, labels: np.ndarray, steps: int = 400) -> Network:
    """Train a fresh network on windows of both labels."""
    rng = np.random.default_rng(4)
    net = Network.fresh(rng)
    target = labels.astype(np.float32)
    pools = [np.flatnonzero(target == v) for v in (0, 1)]
    picks = (np.concatenate([rng.choice(pool, 64) for pool in pools]) for _ in range(steps))
    descend(net, ((own[pick], target[pick], np.float32(1)) for pick in picks), rng, 0.01)
    return net


def refine(net: Network, codes: np.ndarray, labels: np.ndarray, weights: tuple[float, float], batch: int = 128, rate: float = 0.001) -> Network:
    """A copy of the network after one pass over the windows; ``weights`` are those of the two labels."""
    net = replace(net, **dict(zip(PARAMS, [p.copy() for p in net.params()])))
    rng = np.random.default_rng(5)
    order = rng.permutation(len(codes))
    target = labels.astype(np.float32)
    weight = np.where(target > 0, weights[1], weights[0]).astype(np.float32)
    parts = (order[i : i + batch] for i in range(0, len(order), batch))
    descend(net, ((codes[pick], target[pick], weight[pick]) for pick in parts), rng, rate)
    return net


def train(codes: np.ndarray, labels: np.ndarray, steps: int = 400, recall: float = RECALL) -> Network | None:
    """Fit, calibrate and set the threshold; None without both labels on both sides of the split."""
    aside = np.arange(len(codes)) % 4 == 0
    if any(len(set(labels[side].tolist())) < 2 for side in (aside, ~aside)):
        return None
    net = fit(codes[~aside], labels[~aside], steps)
    held = np.concatenate([codes[aside], blanked(codes[aside])])
    truth = np.concatenate([labels[aside]] * 2).astype(float)
    net.scale = platt(np.concatenate([net.forward(held[i : i + 512])[0] for i in range(0, len(held), 512)]).astype(float), truth)
    net.threshold = recall_threshold(net.chance(held), truth, recall)
    return net


def platt(logit: np.ndarray, truth: np.ndarray, times: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and offset of the logistic that fits the labels best, by Newton steps on softened targets; ``times``: how often each occurs."""
    n1, n0 = (times * truth).sum(), (times * (1 - truth)).sum()
    goal = np.where(truth > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (times * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (times * (p - goal)) + 1e-3 * (w - [1.0, 0.0])), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def recall_threshold(chance: np.ndarray, truth: np.ndarray, recall: float, times: np.ndarray | None = None) -> float:
    """Halfway, in log odds, between the highest threshold that still finds this share of the findings and the next non-finding below."""
    found = np.argsort(-chance[truth > 0], kind="stable")
    reached = np.cumsum((np.ones(len(truth)) if times is None else times)[truth > 0][found])
    high = chance[truth > 0][found[np.searchsorted(reached, np.ceil(recall * reached[-1]))]]
    low = max(chance[(truth <= 0) & (chance < high)], default=high)
    odds = [np.log(p / (1 - p)) for p in np.clip([high, low], 1e-9, 1 - 1e-9)]
    return float(1 / (1 + np.exp(-np.mean(odds))))


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, base, found): base spans and candidates of every text, stored."""
    small_batches(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            base, found = [], []
            for value in part["text"]:
                value = value or ""
                base.append(base_spans(value))
                found.append(candidates(value, base[-1]))
            yield pd.DataFrame(
                {
                    "id": part["id"],
                    "base": [[dict(zip(SPAN.names, s)) for s in b] for b in base],
                    "found": [[dict(zip(FOUND.names, c)) for c in f] for f in found],
                }
            )

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("base", T.ArrayType(SPAN)), T.StructField("found", T.ArrayType(FOUND))])
    return staged(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInPandas(run, schema), "scan")


def unpacked(windows: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(w) for w in windows), np.uint8).reshape(-1, WIDTH)


def learn(scanned: DataFrame, most: int = SAMPLE, recall: float = RECALL) -> Network | None:
    """A network from every distinct window; at most ``most`` of each label come to the driver."""
    seen = scanned.select(F.explode("found").alias("c")).select("c.window", "c.known").distinct().withColumn("place", F.xxhash64("window"))
    seen = staged(seen, "windows")
    aside = F.pmod("place", F.lit(4)) == 0
    sizes = {(r["known"], r["aside"]): r["count"] for r in seen.groupBy("known", aside.alias("aside")).count().collect()}

    def least(rows: DataFrame) -> list:
        got = [r for label in (True, False) for r in rows.filter(F.col("known") == label).orderBy("place", "window").limit(most).collect()]
        return sorted(got, key=lambda r: (r["place"], bytes(r["window"])))

    if all(sizes.get((label, True), 0) + sizes.get((label, False), 0) <= most for label in (True, False)):
        rows = least(seen)
        return train(unpacked(r["window"] for r in rows), np.array([r["known"] for r in rows]), recall=recall) if rows else None
    if len(sizes) < 4:
        return None
    rows = least(seen.filter(~aside))
    net = average(seen.filter(~aside), fit(unpacked(r["window"] for r in rows), np.array([r["known"] for r in rows])), sizes[True, False], sizes[False, False])
    return calibrated(seen.filter(aside), net, recall)


def average(seen: DataFrame, net: Network, findings: int, others: int) -> Network:
    """The mean, by windows, of what every shard makes of the network in one pass over its windows."""
    total, held = findings + others, seen.sparkSession.sparkContext.broadcast(net)
    weights = (total / (2 * others), total / (2 * findings))
    shards = -(-total // SHARD)

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("place", "ascending"), ("window", "ascending"), ("known", "ascending")])
        got = refine(held.value, unpacked(shard.column("window").to_pylist()), np.array(shard.column("known").to_pylist()), weights)
        flat = np.concatenate([p.ravel() for p in got.params()]).astype(np.float64) * len(shard)
        return pa.table({"flat": pa.array([flat.tobytes()], pa.binary())})

    dealt = seen.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards))).repartition(shards, "shard")
    done = dealt.groupBy("shard").applyInArrow(run, "flat binary").rdd.map(lambda r: np.frombuffer(r["flat"], np.float64))
    ends = np.cumsum([p.size for p in net.params()])[:-1]
    parts = np.split(done.treeReduce(lambda a, b: a + b) / total, ends)
    return replace(net, **{name: x.reshape(p.shape).astype(np.float32) for name, x, p in zip(PARAMS, parts, net.params())})


def calibrated(seen: DataFrame, net: Network, recall: float) -> Network:
    """The network with scale and threshold set on all these windows, each with and without the text before it."""
    held = seen.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, known = unpacked(batch.column(0).to_pylist()), batch.column(1)
            for form in (codes, blanked(codes)):
                logit = [held.value.forward(form[i : i + 512])[0] for i in range(0, len(form), 512)]
                step = np.round(np.concatenate(logit or [np.zeros(0)]) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(step), known], ["step", "known"])

    told = seen.select("window", "known").mapInArrow(run, "step long, known boolean").groupBy("step", "known").count().collect()
    told = sorted((r["step"], r["known"], r["count"]) for r in told)
    logit, truth, times = (np.array(x, float) for x in zip(*told))
    logit /= STEPS
    scale = platt(logit, truth, times)
    chance = 1 / (1 + np.exp(-np.clip(scale[0] * logit + scale[1], -30, 30)))
    return replace(net, scale=scale, threshold=recall_threshold(chance, truth, recall, times))


def find_secrets(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per document: id, base and spans (base and added, by start, then kind), each an array of (kind, start, stop)."""
    scanned = scan(docs, text, id_column)
    held = docs.sparkSession.sparkContext.broadcast(learn(scanned))

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = held.value
        for part in parts:
            sizes = [len(row) for row in part]
            flat = [c for row in part for c in row]
            if net is None or not flat:
                yield pd.Series([[False] * n for n in sizes])
                continue
            codes = np.frombuffer(b"".join(flat), np.uint8).reshape(len(flat), WIDTH)
            yes = (net.chance(codes) >= net.threshold).tolist()
            ends = np.cumsum(sizes).tolist()
            yield pd.Series([yes[e - n : e] for e, n in zip(ends, sizes)])

    fresh = F.filter("found", lambda c: ~c["known"])
    rows = scanned.select("id", "base", fresh.alias("found"))
    rows = rows.withColumn("yes", F.when(F.size("found") > 0, judged(F.col("found.window"))))
    both = F.filter(F.arrays_zip("found", "yes"), lambda x: x["yes"])
    added = F.transform(both, lambda x: F.struct(F.lit("model").alias("kind"), x["found"]["start"].alias("start"), x["found"]["stop"].alias("stop")))
    rank = {kind: i for i, kind in enumerate(KINDS)}
    places = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    everything = F.concat("base", F.coalesce(added, F.array().cast(T.ArrayType(SPAN))))
    keyed = F.array_sort(F.transform(everything, lambda s: F.struct(s["start"].alias("start"), places[s["kind"]].alias("place"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    spans = F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return rows.select(F.col("id").alias(id_column), "base", spans.alias("spans"))
