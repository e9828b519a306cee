"""Token counts by heap-and-linked-list byte-pair merging.

A text becomes a line of symbols, its characters after the model's own
preparation (a leading space mark, spaces written as that mark).  A heap holds
the adjacent pairs that form a piece, by rank and then position; popping the
lowest merges the pair in a doubly linked list and pushes the two new
neighbours.  The count is the weight of the initial symbols less what the
merges save; no identifier is produced.  A character without a piece weighs as
many tokens as it has UTF-8 bytes (byte fallback).

Pieces never hold a space mark after another character and never a line feed,
which is checked on loading, so merges cannot cross those places: a text is
counted word by word, and counts of words are remembered in a table of bounded
size.  A model without that property is counted text by text.

Nulls count as empty (0 tokens); repeated rows each give a row; very long texts
are only ever held one at a time; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import short_batches
from .memo import Memo

MARK = "▁"


class PieceModel:
    """Ranks of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        normal.sort(key=lambda i: -model.get_score(i))
        self.piece = [model.id_to_piece(i) for i in normal]
        self.rank = {p: r for r, p in enumerate(self.piece)}
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.by_line = not any("\n" in p for p in self.rank)
        #: Neighbours inside pieces: between any others no merge can take place.
        self.touching = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}

    def weight(self, symbol: str) -> int:
        return 1 if symbol in self.rank else len(symbol.encode("utf-8", "surrogatepass"))

    def count(self, prepared: str) -> int:
        """Tokens of text in which spaces are marks already."""
        get, piece, n = self.rank.get, self.piece, len(prepared)
        symbol: list[str] = list(prepared)
        # an entry of the heap is rank * n + position
        heap = [r * n + i for i, r in enumerate(map(get, map(str.__add__, prepared, prepared[1:]))) if r is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        total = sum(map(self.weight, prepared))
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            left, j = symbol[i], after[i]
            if j >= n or not left or left + (right := symbol[j]) != (pair := piece[r]):
                continue  # one of the two has since merged with another
            total -= 1 if len(pair) > 3 else self.weight(left) + self.weight(right) - 1
            symbol[i], symbol[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(pair + symbol[k])) is not None:
                    heapq.heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := get(symbol[h] + pair)) is not None:
                heapq.heappush(heap, r * n + h)
        return total


class Counter:
    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.inner, self.first = Memo(lambda words: self.words(words, MARK)), Memo(lambda words: self.words(words, ""), 100_000)
        self.runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.tails: dict[str, int] = {}

    def words(self, words: list[str], lead: str) -> list[int]:
        """Counts of words; what follows a word's last letter is counted apart where nothing can join the two."""
        count, touching, out, cores = self.model.count, self.model.touching, [], {}
        for w in words:
            core = w.rstrip(",.;:!?")
            tail = w[len(core) :]
            if not core or not tail or len(tail) > 4 or core[-1] + tail[0] in touching:
                out.append(count(lead + w))
                continue
            if (n := self.tails.get(tail)) is None:
                n = self.tails[tail] = count(tail)
            if (m := cores.get(core)) is None:
                m = cores[core] = count(lead + core)
            out.append(m + n)
        return out

    def line(self, text: str, lead: bool) -> int:
        words = text.split(" ")
        if "" in words or MARK in text:  # several marks together
            return sum(self.first(self.runs.findall(MARK * lead + text.replace(" ", MARK))))
        return sum(self.inner(words)) if lead else sum(self.first(words[:1])) + sum(self.inner(words[1:]))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not (self.model.by_word and self.model.by_line):
            return self.model.count(MARK + text.replace(" ", MARK))
        lines = text.split("\n")
        total = (len(lines) - 1) * self.model.weight("\n")
        if "  " in text or MARK in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return total + sum(self.line(x, k == 0) for k, x in enumerate(lines) if x or k == 0)
        heads = [h for x in lines if (h := x.split(" ", 1)[0])]
        inner = [w for x in lines for w in x.split(" ")[1:]]
        if lines[0]:
            inner.append(heads.pop(0))
        else:
            total += self.model.weight(MARK)
        return total + sum(self.first(heads)) + sum(self.inner(inner))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row's whole text."""
    short_batches(docs.sparkSession)

    def count(texts: pd.Series) -> pd.Series:
        of = counter(model)
        return pd.Series([of(t) for t in texts], dtype="int64")

    count.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.pandas_udf(count, "long")("text").alias("n_tokens"))
    return counted.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
