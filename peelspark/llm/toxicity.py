"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

A text's features are the distinct hashes of its words, of the first bytes of
its words (stems), of word pairs and of pairs with one word between them.
Training visits a bounded sample of labelled rows in a fixed order with
per-coordinate rates and an L1 penalty, which leaves few weights other than
zero.  One executor task fits the model and only the weights reach the driver;
they are sent to the executors, and every whole text is scored in one pass
without a shuffle.

The sample takes each labelled id by a hash of it with a chance that gives
about ``PER_CLASS`` ids of each label, fewer where there are fewer; of rows that
share an id one is learned from, the one with the least features in byte order.
Rows with a null label or id aren't learned from; of repeated labels the largest
counts.  A null or empty text has no features and gets the score of the bias
alone; with no labelled rows every score is that of ``NO_LABELS``, about 1e-13.
Repeated rows are scored alike; extra columns are kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import BROADCAST, drop, keep
from .batches import short_batches
from .fitting import Spool, fitted
from .hashing import _powers, mix

BITS = 22
#: Bound of the training sample, rows of either label.
PER_CLASS = 3_000
STEMS = (4, 5, 6)
THRESHOLD = 0.7
#: The bias without any labelled row.
NO_LABELS = -30.0
_BETWEEN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_KINDS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def features(text: str | None) -> list[np.ndarray]:
    """Feature numbers of a whole text by kind, with repeats."""
    b = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(b):
        return []
    edge = np.diff(np.concatenate(([True], _BETWEEN[b], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return []
    up, down = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    base, shift = down[starts], np.uint64(64 - BITS)
    words = mix((total[ends] - total[starts]) * base)
    out = [words]
    for kind, n in zip(_KINDS, STEMS, strict=False):
        long = ends - starts > n
        out.append(mix((total[starts[long] + n] - total[starts[long]]) * base[long] + kind))
    out += [mix(words[:-gap] * kind + words[gap:]) for kind, gap in zip(_KINDS[3:], (1, 2), strict=False) if len(words) > gap]
    return [(h >> shift).astype(np.int32) for h in out]


def fit(rows: list[np.ndarray] | Spool, labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.05, passes: int = 6) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, feature numbers, weights) of a model whose other weights are zero."""
    # places for the features that occur, fewer than there are hashes
    held = np.zeros(1 << BITS, bool)
    for x in rows:
        held[x] = True
    place = np.cumsum(held, dtype=np.int32) - 1
    z, n = np.zeros(held.sum()), np.zeros(held.sum())
    bias = bias_n = 0.0
    for _ in range(passes):
        for x, y in zip(rows, labels, strict=True):
            x = place[x]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + bias_n**0.5)
    at = np.flatnonzero(np.abs(z) > l1).astype(np.int32)
    return bias, np.flatnonzero(held)[at].astype(np.int32), ((np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)).astype(np.float32)


def held_out(doc_id, modulus: int, remainder: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; rows of the held-out third are left out."""
    short_batches(docs.sparkSession)
    marked = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in marked.filter("doc_id IS NOT NULL").groupBy("y").count().collect()}
    if not sizes:
        return NO_LABELS, np.zeros(0, np.int32), np.zeros(0, np.float32)
    chance = F.lit(0.0)
    for y, n in sizes.items():
        chance = F.when(F.col("y") == y, F.lit(min(1.0, PER_CLASS / n))).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = keep(marked.filter("doc_id IS NOT NULL").filter(draw < chance), "sampled-labels")
    few = F.broadcast(sample) if sample.count() * 32 <= BROADCAST else sample

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [np.unique(np.concatenate(f)).tobytes() if (f := features(t)) else b"" for t in b["text"]]})

    def learn(labels: pd.DataFrame, x: Spool) -> list[tuple]:
        bias, at, weights = fit(x, labels["y"].to_numpy(float))
        return [(bias, at.tobytes(), weights.tobytes())]

    marked_rows = docs.select("doc_id", "text").join(few, "doc_id").mapInPandas(rows, "doc_id long, y int, x binary")
    once = marked_rows.groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    model = fitted(once.withColumn("place", F.xxhash64(F.lit(6), "doc_id")), ["place", "doc_id"], {"x": "<i4"}, ["y"], learn, "bias double, at binary, weights binary")
    drop(sample)
    return model[0]["bias"], np.frombuffer(model[0]["at"], np.int32), np.frombuffer(model[0]["weights"], np.float32)


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (its columns packed as ``row``) with ``score`` and ``predicted``."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(texts: pd.Series) -> pd.Series:
        bias, at, weights = sent.value
        table = np.zeros(1 << BITS, np.float32)
        table[at] = weights
        out = []
        for t in texts:
            hit = [f[table[f] != 0] for f in features(t)]
            s = bias + float(table[np.unique(np.concatenate(hit))].sum(dtype=np.float64)) if hit else bias
            out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, s)))))
        return pd.Series(out, dtype="float64")

    rate.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    rated = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("score", F.pandas_udf(rate, "double")("row.text"))
    return rated.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
