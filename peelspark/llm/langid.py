"""Language identification by sparse multinomial regression on character n-grams.

A lower-cased text, its runs of non-letters made one space, is counted by
hashed 1- to 3-grams.  Document frequencies come from every document that may
be learned from.  The model is trained on a bounded sample, about ``SAMPLE``
documents spread over the languages, by follow-the-regularised-leader steps
with L1 and L2 penalties; a temperature fitted on a fifth of the sample, kept
from training, calibrates the probabilities.  One executor task fits; the model,
whose size the number of languages sets, is what the driver receives.

Null texts and texts without letters are ``und`` with score 0; without any
labelled document all are.  Of sampled rows that share an id and a language one
is learned from, and rows without an id count as sharing one.  Repeated rows are rated alike; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import short_batches
from .fitting import Spool, fitted
from .toxicity import held_out

BITS = 15
#: Bound of the training sample, over all languages together.
SAMPLE = 6_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(numbers, counts) of a text's hashed n-grams; None without letters."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, 32).astype(np.uint64)
    c = np.concatenate(([np.uint64(32)], c[np.concatenate(([True], letter[1:] | letter[:-1]))], [np.uint64(32)]))
    two = c[:-1] * np.uint64(0x1F83D9ABFB41BD6B) + c[1:]
    three = two[:-1] * np.uint64(0x1F83D9ABFB41BD6B) + c[2:]
    h = np.concatenate((c, two + np.uint64(1 << 40), three + np.uint64(1 << 41))) * _ODD
    n = np.bincount(((h ^ (h >> np.uint64(29))) * _ODD >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


def weighed(grams: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = grams
    x = np.log1p(n) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


class Weighed(Sequence):
    """TF-IDF vectors of spooled n-gram counts, made when they are asked for."""

    def __init__(self, at: Spool, n: Spool, idf: np.ndarray) -> None:
        self.at, self.n, self.idf = at, n, idf

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return weighed((self.at[i].astype(np.int64), self.n[i]), self.idf)


def fit(rows: Sequence, labels: np.ndarray, k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, passes: int = 3) -> np.ndarray:
    """Weights, a row for each n-gram; the last row is the bias."""
    z, n = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))
    solve = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(passes):
        for (at, x), y in zip(rows, labels, strict=False):
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            zx, nx = z[at], n[at]
            w = solve(zx, nx)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[at] = nx + g * g
    return solve(z, n)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 80))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame) -> dict:
    """Model of ``docs(doc_id, text, lang)``; the held-out quarter and null languages are left out."""
    short_batches(docs.sparkSession)
    may = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in may.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, rows = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for t in b["text"]:
                if g := ngrams(t):
                    n[g[0]] += 1
                    rows += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"gram": np.append(at, -1), "docs": np.append(n[at], rows)})

    found = may.mapInPandas(present, "gram int, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).toPandas()
    total = int(found.loc[found["gram"] == -1, "docs"].sum())
    df = np.zeros(1 << BITS)
    held = found[found["gram"] >= 0]
    df[held["gram"]] = held["docs"]
    idf = np.log((1 + total) / (1 + df)) + 1

    chance = F.lit(0.0)
    for x in langs:
        chance = F.when(F.col("lang") == x, F.lit(min(1.0, SAMPLE / len(langs) / sizes[x]))).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            grams = [ngrams(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "at": [g and g[0].astype(np.uint16).tobytes() for g in grams], "n": [g and g[1].astype(np.int32).tobytes() for g in grams]})[[g is not None for g in grams]]

    def learn(labels: pd.DataFrame, at: Spool, n: Spool) -> list[tuple]:
        data = Weighed(at, n, idf)
        y = labels["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
        kept = len(data) - len(data) // 5
        w = fit(data, y[:kept], len(langs))
        rest = np.array([x @ w[at] + w[-1] for at, x in (data[i] for i in range(kept, len(data)))]).reshape(-1, len(langs))
        return [(len(data), w.astype(np.float32).tobytes(), temperature(rest, y[kept:]))]

    grams = may.filter(draw < chance).mapInPandas(rows, "doc_id long, lang string, at binary, n binary")
    once = grams.groupBy("doc_id", "lang").agg(F.min(F.struct("at", "n")).alias("g"))
    sample = once.select("lang", F.col("g.at").alias("at"), F.col("g.n").alias("n"), F.xxhash64(F.lit(8), "doc_id", "lang").alias("place"))
    model = fitted(sample, ["place", "lang", "at", "n"], {"at": "<u2", "n": "<i4"}, ["lang"], learn, "learned long, w binary, t double")[0]
    if not model["learned"]:
        return {"langs": []}
    return {"langs": langs, "idf": idf.astype(np.float32), "w": np.frombuffer(model["w"], np.float32).reshape(-1, len(langs)), "t": model["t"]}


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(texts: pd.Series) -> pd.DataFrame:
        m, out = sent.value, []
        for t in texts:
            g = ngrams(t) if m["langs"] else None
            if not g:
                out.append(("und", 0.0))
                continue
            at, x = weighed(g, m["idf"])
            p = softmax((x @ m["w"][at] + m["w"][-1]).astype(float) / m["t"])
            out.append((m["langs"][int(p.argmax())], float(p.max())))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    rate.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    asked = docs.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.pandas_udf(rate, "lang_pred string, score double")("text").alias("rated"))
    return asked.select("doc_id", "held_out", "rated.*")
