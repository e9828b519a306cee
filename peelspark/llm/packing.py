"""Packing of documents into fixed windows by the sum-of-squares rule.

A document's token ids, followed by the closing id 0, are cut into full windows
and one rest shorter than a window; full windows are sequences of their own.
Rests are packed online: with ``N(h)`` the number of open sequences filled to
level ``h``, a rest of size ``s`` goes into the level whose choice makes
``sum N(h)^2`` smallest afterwards (level 0: a new sequence), which only needs
the level array.  Ties go to the fullest level.

The rule leaves about a tenth of the sequences part-filled (1.8 % padding on
10,000 documents).  One rest in ``MATERIAL`` is therefore not placed whole: it
travels with its ids, and once the others are placed it is cut freely, first into
the gaps of the open sequences, the smallest gaps first, then into whole windows,
and what is left into sequences of powers of two, which need no padding.  Gaps
stay only where there is less material than that.

Rests are dealt by a hash of their document into shards of about ``SHARD`` rests;
each shard runs the rule on its own level array, so a task holds a bounded number
of rows at any size of the corpus (the ids of its material are some 15 MB).

Null text is an empty document (the closing id alone).  Repeated rows are each
packed.  A null ``doc_id`` is kept as null.  Extra columns are ignored; an empty
table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import keep
from .batches import short_batches

#: Rests that one shard packs, on average.
SHARD = 65_536
#: One rest in so many fills gaps.
MATERIAL = 8
PIECES = "array<struct<start:long,length:long,ids_crc32:long,doc_tokens:long,ids:binary>>"
PLACED = "doc_id long, lone boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteEncoder:
    """Ids as little-endian bytes, by the rank table that holds the tokenizer's own vocabulary.

    Texts with one of the tokenizer's special strings, and any that the rank
    table's pattern engine gives up on, go to the tokenizer itself.
    """

    def __init__(self, ranks: str, whole: str, pattern: str) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.whole = whole
        with open(whole, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]

    @cached_property
    def exact(self):
        """The tokenizer itself, loaded by workers that meet a text for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.whole)

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            try:
                return array("I", self.fast.encode_ordinary(text)).tobytes()
            except BaseException as e:
                if type(e).__name__ != "PanicException":
                    raise
        return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=1)
def encoder(ranks: str, whole: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(ranks, whole, pattern)


def pieces(docs: DataFrame, ranks: str, whole: str, pattern: str, window: int = 1024) -> DataFrame:
    """``doc_id, lone`` (it is null) and the full windows and the rest of every document, with the checksum of their ids; ``ids`` of the material."""

    def cut(texts: pd.Series) -> pd.Series:
        of, out = encoder(ranks, whole, pattern), []
        for text in texts:
            ids = of.encode(text or "") + b"\0\0\0\0"
            n, rows = len(ids) // 4, []
            for at in range(0, n, window):
                own = ids[4 * at : 4 * (at + window)]
                crc, length = zlib.crc32(own), len(own) // 4
                rows.append({"start": at, "length": length, "ids_crc32": crc, "doc_tokens": n, "ids": own if length < window and crc % MATERIAL == 0 else None})
            out.append(rows)
        return pd.Series(out, dtype=object)

    cut.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    doc = F.col("doc_id").cast("long")
    made = docs.select(F.coalesce(doc, F.lit(0)).alias("doc_id"), doc.isNull().alias("lone"), F.explode(F.pandas_udf(cut, PIECES)("text")).alias("p"))
    return made.select("doc_id", "lone", "p.*")


class Levels:
    """The level array and the open sequences at each level."""

    def __init__(self, window: int) -> None:
        self.window, self.n, self.open, self.made = window, np.zeros(window + 1, np.int64), defaultdict(list), 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a rest of ``size`` tokens."""
        n, top = self.n, self.window - size
        # N(h) -> N(h) - 1 and N(h + size) -> N(h + size) + 1; level 0 opens a sequence, the full level isn't counted
        change = 2 * (n[size : size + top + 1] - n[: top + 1] + 1)
        change[0] = 2 * n[size] + 1
        change[top] = 1 - 2 * n[top] if top else 0
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        h = top - int(np.argmin(change[::-1]))
        if h:
            sequence = self.open[h].pop()
            n[h] -= 1
        else:
            sequence, self.made = self.made, self.made + 1
        if h + size < self.window:
            self.open[h + size].append(sequence)
            n[h + size] += 1
        return sequence, h


class Material:
    """Rests to be cut: ``take(n)`` gives ``(row, start, ids)`` of the next ``n`` tokens."""

    def __init__(self, ids: list[bytes]) -> None:
        self.ids, self.row, self.at, self.left = ids, 0, 0, sum(map(len, ids)) // 4

    def take(self, n: int) -> Iterator[tuple[int, int, bytes]]:
        self.left -= n
        while n:
            own = self.ids[self.row]
            size = min(n, len(own) // 4 - self.at)
            yield self.row, self.at, own[4 * self.at : 4 * (self.at + size)]
            n, self.at = n - size, self.at + size
            if 4 * self.at == len(own):
                self.row, self.at = self.row + 1, 0


def filled(levels: Levels, material: Material) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(sequence, offset, row, start in its rest, ids) of the pieces that the material is cut into."""

    def put(sequence: int, offset: int, n: int) -> Iterator[tuple[int, int, int, int, bytes]]:
        for row, start, ids in material.take(n):
            yield sequence, offset, row, start, ids
            offset += len(ids) // 4

    for level in sorted(levels.open, reverse=True):
        for sequence in levels.open[level]:
            if material.left >= levels.window - level:
                yield from put(sequence, level, levels.window - level)
    while size := min(levels.window, 1 << material.left.bit_length() >> 1):
        levels.made += 1
        yield from put(levels.made - 1, 0, size)


def pack(docs: DataFrame, ranks: str, whole: str, pattern: str, window: int = 1024) -> DataFrame:
    """Every piece with its sequence and place there; sequences never exceed ``window``."""
    short_batches(docs.sparkSession)
    made = keep(pieces(docs, ranks, whole, pattern, window), "pieces")
    rests = made.filter(F.col("length") < window)
    shards = max(1, -(-rests.count() // SHARD))
    # a full window is a sequence by itself: odd numbers, apart from the shards' even ones
    full = made.filter(F.col("length") == window).drop("ids").withColumns({"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")})

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="shard").sort_values(["lone", "doc_id", "ids_crc32", "length"], ignore_index=True)
        loose = rows["ids"].notna()
        cuts, whole = rows[loose], rows[~loose].drop(columns="ids")
        levels = Levels(window)
        placed = [levels.place(int(s)) for s in whole["length"]]
        out = [whole.assign(sequence_id=[s for s, _ in placed], offset=[at for _, at in placed])]
        new = list(filled(levels, Material(cuts["ids"].to_list())))
        if new:
            at = cuts.iloc[[row for _, _, row, _, _ in new]].drop(columns="ids")
            out.append(at.assign(start=at["start"].to_numpy() + [x[3] for x in new], length=[len(x[4]) // 4 for x in new], ids_crc32=[zlib.crc32(x[4]) for x in new], sequence_id=[x[0] for x in new], offset=[x[1] for x in new]))
        got = pd.concat(out, ignore_index=True)
        return got.assign(sequence_id=2 * ((int(key[0]) << 32) | got["sequence_id"].astype("int64")))

    shard = F.pmod(F.xxhash64(F.lit(7), "doc_id", "ids_crc32"), F.lit(shards))
    packed = rests.withColumn("shard", shard).groupBy("shard").applyInPandas(fill, PLACED)
    return full.unionByName(packed).withColumn("doc_id", F.when(~F.col("lone"), F.col("doc_id"))).drop("lone")
