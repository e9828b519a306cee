"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark items; long items are cut into parts.
1. The documents' words as numbers of terms, kept as a table, and the terms' frequencies
   over all passages of all documents.
2. Randomised SVD of the TF-IDF matrix of all passages and the parts (a row for every
   ``WINDOW`` words, so that each word is in one row): the products with the random
   matrix and the Gram matrix of the projection are sums over partitions; only
   matrices of terms by rank reach the driver.
3. Passages (windows of ``WINDOW`` words, a new one every ``STRIDE``) and parts are
   folded into the latent space, and every passage is compared with every part.  A
   pair is a candidate from a floor on, which depends on the lengths of both: what
   step 4 asks for makes a least product of the whole vectors, and the parts of the
   vectors that the rank cuts off have at most the product of their lengths
   (Cauchy-Schwarz).  No pair that step 4 accepts is below that floor.
4. A candidate counts if the longest common subsequence of words covers
   ``COVER`` of the part and at least half of its answer terms, the rarest
   third, are there.  A part of fewer than ``SHORT`` words must occur as it is.

A fixed floor on the cosine would lose short parts (3 words in 80 have a cosine of
about 0.2 even if they occur as they are).

The benchmark is the query set.  Its parts are taken in groups of ``GROUP`` words,
each of one scan of the corpus, and inside a group in blocks of ``BLOCK`` words that
read the kept numbers alone, so that what is sent to executors and the matrices of
the driver are bounded.  Null or empty texts and items match
nothing; an empty benchmark leaves all documents clean; repeated rows are rated
alike (rows that share a ``doc_id`` share the findings, rows without one are
told apart by their text); extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import drop, keep
from .batches import short_batches
from .hashing import word_hashes

#: Words of the parts that a scan looks for, and of those that one decomposition holds (its matrices have a row for each).
GROUP, BLOCK = 1 << 20, 1 << 14
WINDOW, STRIDE, PART = 80, 20, 56
RANK, EXTRA = 256, 16
COVER, SHORT = 0.6, 8
#: Rows of the SVD's products that are summed together.
ROWS = 16
#: The most frequent terms, which are counted in whole matrices; cells that are taken at a time; pairs that are checked at a time.
COMMON, CELLS, PAIRS = 256, 4096, 1 << 18
_BETWEEN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
FOUND = "doc string, item_id long, cosine double, cover double"


def key_of(doc_id: str, text: str) -> Column:
    """What tells documents apart: the id, and the text's hash where there is none."""
    text = F.col(f"`{text}`")
    own = F.concat(F.lit("t"), F.hex(F.xxhash64(text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text)))
    return F.coalesce(F.col(f"`{doc_id}`").cast("long").cast("string"), own)


def words_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower().encode("utf-8", "surrogatepass"), _BETWEEN)


class Terms:
    """Numbers of the benchmark's words; -1 for other words."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(words & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int32)
        at = np.flatnonzero(self.maybe[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        to = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
        same = self.words[to] == words[at]
        out[at[same]] = to[same]
        return out


def cut(words: np.ndarray) -> list[np.ndarray]:
    """An item's parts."""
    n = -(-len(words) // PART)
    return np.array_split(words, n) if n else []


def bounded(parts: Iterable[tuple[int, np.ndarray]], words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The parts, in order, in lists of at most so many words."""
    now, n = [], 0
    for item, part in parts:
        if now and n + len(part) > words:
            yield now
            now, n = [], 0
        now.append((item, part))
        n += len(part)
    if now:
        yield now


class Block:
    """Parts of the items, as numbers of a group's terms, with numbers of their own, the most frequent first."""

    def __init__(self, parts: list[tuple[int, np.ndarray]], df: np.ndarray, passages: int) -> None:
        self.item, self.given = [i for i, _ in parts], [w for _, w in parts]
        own = np.unique(np.concatenate(self.given))
        own = own[np.argsort(-df[own], kind="stable")]
        self.number = np.full(len(df) + 1, -1, np.int32)  # the last is for -1
        self.number[own] = np.arange(len(own))
        self.ids = [self.number[w] for w in self.given]
        self.weight = float(max(1, passages))
        self.idf = np.log((1 + passages) / (1 + df[own])).astype(np.float32) + np.float32(0.1)
        self.common = min(COMMON, len(own))
        answers, least, floor, length = [], [], [], []
        for ids in self.ids:
            at, n = np.unique(ids, return_counts=True)
            order = np.lexsort((at, -self.idf[at]))[: max(1, -(-len(at) // 3))]
            answers.append(at[order])
            least.append(-(-len(order) // 2))
            length.append(float(np.sqrt(((n * self.idf[at]) ** 2).sum())))
            floor.append(self._floor(n, n * self.idf[at] ** 2, order, least[-1], len(ids)) / length[-1])
        self.least, self.floor, self.length = np.array(least), np.array(floor, np.float32), np.array(length, np.float32)
        self.asked = np.full((len(answers), max(map(len, answers))), len(own), np.int32)
        for row, x in zip(self.asked, answers, strict=True):
            row[: len(x)] = x

    @staticmethod
    def _floor(n: np.ndarray, value: np.ndarray, answer: np.ndarray, least: int, size: int) -> float:
        """The least product with a passage that has what is asked for; ``value`` is what one occurrence of a term adds."""
        if size < SHORT:
            return float((n * value).sum())
        # of the answer the least values; the words besides at their least
        rest = max(0, int(np.ceil(COVER * size - 1e-6)) - int(np.sort(n[answer])[-least:].sum()))
        return float(np.sort(value[answer])[:least].sum() + np.sort(np.repeat(value, n))[:rest].sum())


def windows(n: int) -> np.ndarray:
    """Starts of the passages of a text of ``n`` words: every word lies in one, any ``WINDOW - STRIDE`` in a row lie in one."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def numbered(docs: DataFrame, terms: Terms) -> DataFrame:
    """``doc, ids``: the words of every document as numbers of terms, -1 for others."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = sent.value
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "ids": [of(words_of(t)).tobytes() for t in b["text"]]})

    return docs.filter("text IS NOT NULL").select("doc", "text").mapInPandas(number, "doc string, ids binary")


class Laid:
    """Texts cut into cells of ``width`` words, with ``pad`` empty ones after each text: cell and number of every word that has one."""

    def __init__(self, texts: list[np.ndarray], number: np.ndarray, width: int, pad: int = 0) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        cells = np.maximum(1, -(-sizes // width)) + pad
        self.first, self.n = np.concatenate(([0], np.cumsum(cells)[:-1])).astype(np.int64), int(cells.sum())
        terms = number[np.concatenate(texts)] if len(texts) else np.zeros(0, np.int32)
        place = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(terms >= 0)
        self.cell, self.term = (np.repeat(self.first, sizes) + place // width)[at], terms[at]

    def pieces(self, cells: int, more: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """So many cells at a time, and ``more`` after them: the first, how many, and the words with cells from 0."""
        for a in range(0, self.n, cells):
            i, j = np.searchsorted(self.cell, (a, a + cells + more))
            yield a, min(cells, self.n - a) + more, self.cell[i:j] - a, self.term[i:j]


def _add(out: np.ndarray, to: np.ndarray, rows: np.ndarray, of: np.ndarray) -> None:
    """``out[to] += rows[of]`` for sorted ``to`` with repeats: the first of every ``to``, then the second, and so on."""
    start = np.flatnonzero(np.diff(to, prepend=-1))
    n = np.diff(start, append=len(to))
    order = np.argsort(-n, kind="stable")
    start, left = start[order], np.searchsorted(-n[order], -np.arange(n.max(initial=0)), side="left")
    for i, many in enumerate(left.tolist()):
        at = start[:many] + i
        out[to[at]] += rows[of[at]]


class Counts:
    """Term counts of cells, of common terms as a matrix and of the others by word."""

    def __init__(self, n: int, cell: np.ndarray, term: np.ndarray, common: int) -> None:
        often = term < common
        self.dense = np.bincount(cell[often] * common + term[often], minlength=n * common).reshape(n, common).astype(np.float32)
        self.cell, self.term, self.common = cell[~often], term[~often], common

    def times(self, right: np.ndarray) -> np.ndarray:
        out = self.dense @ right[: self.common]
        _add(out, self.cell, right, self.term)
        return out

    def turned_times(self, right: np.ndarray, out: np.ndarray) -> None:
        out[: self.common] += self.dense.T @ right
        order = np.argsort(self.term, kind="stable")
        _add(out, self.term[order], right, self.cell[order])


def _texts(b: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in b["ids"]]


def frequencies(held: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages (cut without overlap) each of ``size`` terms occurs, and the number of passages."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, df = 0, np.zeros(size, np.int64)
        same = np.append(np.arange(size, dtype=np.int32), np.int32(-1))
        for b in batches:
            texts = _texts(b)
            total += sum(-(-len(t) // WINDOW) for t in texts)
            for _, _, cell, term in Laid(texts, same, WINDOW).pieces(CELLS):
                # pairs of passage and term, once each
                df += np.bincount(np.unique(cell * size + term) % size, minlength=size)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(df[at], total)})

    got = held.mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size, np.int64)
    seen = got[got["term"] >= 0]
    df[seen["term"]] = seen["n"]
    return df, int(got.loc[got["term"] < 0, "n"].sum())


def _summed(held: DataFrame, block: Block, right: np.ndarray, gram: bool) -> np.ndarray:
    """``A' A right``, or with ``gram`` ``(A right)' (A right)``, for the TF-IDF rows A of all passages and the parts, which together weigh as much."""
    weighted = (block.idf[:, None] * right).astype(np.float32)
    sent = held.sparkSession.sparkContext.broadcast((block.number, block.idf, block.common, weighted))

    def add(texts: Iterable[list[np.ndarray]], number: np.ndarray, idf: np.ndarray, common: int, right: np.ndarray) -> np.ndarray:
        out = np.zeros((right.shape[1],) * 2 if gram else right.shape)
        for own in texts:
            for _, n, cell, term in Laid(own, number, WINDOW).pieces(CELLS):
                counts = Counts(n, cell, term, common)
                y = counts.times(right)
                if gram:
                    out += y.T @ y
                else:
                    counts.turned_times(y, out)
        return out if gram else out * idf[:, None]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = add(map(_texts, batches), *sent.value)
        at = [i for i in range(0, len(got), ROWS) if got[i : i + ROWS].any()]
        yield pd.DataFrame({"row": at, "m": [got[i : i + ROWS].tobytes() for i in at]})

    def summed(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "m": [np.sum([np.frombuffer(x) for x in g["m"]], axis=0).tobytes()]})

    total = block.weight * add([block.given], *sent.value)
    for r in held.select("ids").mapInPandas(partial, "row int, m binary").groupBy("row").applyInPandas(summed, "row int, m binary").toLocalIterator():
        total[r["row"] : r["row"] + ROWS] += np.frombuffer(r["m"]).reshape(-1, total.shape[1])
    return total


def latent(held: DataFrame, block: Block) -> np.ndarray:
    """Leading right singular vectors, terms by rank."""
    size = len(block.idf)
    width = min(size, RANK + EXTRA)
    random = np.random.default_rng(7).standard_normal((size, width))
    basis, _ = np.linalg.qr(_summed(held, block, random, False))
    values, turn = np.linalg.eigh(_summed(held, block, basis, True))
    return (basis @ turn[:, np.argsort(-values)[:RANK]]).astype(np.float32)


def common_subsequence(part: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``part``."""
    masks: dict[int, int] = {}
    for i, w in enumerate(part):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(part)) - 1
    state = full
    for w in words:
        if m := masks.get(w):
            u = state & m
            state = ((state + u) | (state - u)) & full
    return len(part) - state.bit_count()


def _holds(words: np.ndarray, part: np.ndarray) -> bool:
    """Whether ``part`` occurs in ``words`` as it is."""
    n = len(part)
    return len(words) >= n and bool((np.lib.stride_tricks.sliding_window_view(words, n) == part).all(1).any())


class Search:
    """Retrieval of a block's parts by their passages in the latent space."""

    def __init__(self, block: Block, space: np.ndarray) -> None:
        self.block, self.fold = block, block.idf[:, None] * space
        self.squares = block.idf**2
        folded = np.array([self.fold[ids].sum(0) for ids in block.ids]) / block.length[:, None]
        self.size = np.maximum(np.linalg.norm(folded, axis=1), 1e-9)
        left = np.sqrt(np.maximum(1 - self.size**2, 0) + 1e-5)
        #: latent vectors of the parts at length 1, and how long what the rank cuts off is
        self.parts = np.column_stack((folded, left)).astype(np.float32)

    def candidates(self, n: int, cell: np.ndarray, term: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of passage and part from the floor on, with their cosine; passages begin at the cells ``starts``."""
        many = WINDOW // STRIDE
        m = n - many + 1
        counts = Counts(n, cell, term, self.block.common)

        def over(x: np.ndarray) -> np.ndarray:
            out = x[:m] + x[1 : m + 1]
            for i in range(2, many):
                out += x[i : i + m]
            return out[starts]

        y = over(counts.times(self.fold))
        square = (over(counts.dense) ** 2) @ self.squares[: counts.common]
        size = len(self.block.idf)
        place = np.full(m, -1, np.int64)
        place[starts] = np.arange(len(starts))
        at = np.concatenate([counts.cell - i for i in range(many)])
        inside = (at >= 0) & (at < m)
        at, own = place[at[inside]], np.tile(counts.term, many)[inside]
        key, times = np.unique((at * size + own)[at >= 0], return_counts=True)
        square += np.bincount(key // size, times.astype(np.float64) ** 2 * self.squares[key % size], minlength=len(starts)).astype(np.float32)
        inner = (y * y).sum(1)
        # what the rank cuts off, and room for rounding
        left = np.sqrt(np.maximum(square - inner, 0) + 1e-5 * square)
        best = np.column_stack((y, left)) @ self.parts.T
        k, p = np.nonzero(best >= self.block.floor * (1 - 1e-4))
        cosine = (best[k, p] - left[k] * self.parts[p, -1]) / (np.maximum(np.sqrt(inner[k]), 1e-9) * self.size[p])
        return k, p, cosine

    def answered(self, n: int, cell: np.ndarray, term: np.ndarray, starts: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Which of the pairs have half of the part's answer terms."""
        there = np.zeros((n, len(self.block.idf) + 1), bool)
        for i in range(WINDOW // STRIDE if len(k) else 0):
            at = cell >= i
            there[cell[at] - i, term[at]] = True
        out = [np.zeros(0, bool)]
        for i in range(0, len(k), PAIRS):
            q = p[i : i + PAIRS]
            out.append(there[starts[k[i : i + PAIRS], None], self.block.asked[q]].sum(1) >= self.block.least[q])
        return np.concatenate(out)

    def found(self, docs: list[str], texts: list[np.ndarray]) -> list[tuple[str, int, float, float]]:
        block, out = self.block, []
        many = WINDOW // STRIDE
        laid = Laid(texts, block.number, STRIDE, many - 1)
        passages = np.array([len(windows(len(t))) for t in texts], np.int64)
        of = np.repeat(np.arange(len(texts)), passages)
        begin = np.arange(len(of)) - np.repeat(np.cumsum(passages) - passages, passages)
        starts = laid.first[of] + begin if len(of) else of
        for a, n, cell, term in laid.pieces(max(64, min(CELLS, (1 << 25) // len(block.idf))), many - 1):
            i, j = np.searchsorted(starts, (a, a + n - many + 1))
            own = starts[i:j] - a
            k, p, cosine = self.candidates(n, cell, term, own)
            at = self.answered(n, cell, term, own, k, p)
            for w, q, c in zip((k[at] + i).tolist(), p[at].tolist(), cosine[at].tolist(), strict=True):
                text, part = texts[of[w]], block.ids[q]
                first = int(begin[w]) * STRIDE
                words = block.number[text[first : first + WINDOW]]
                if len(part) < SHORT:
                    if not _holds(words, part):
                        continue
                    cover = 1.0
                elif (cover := common_subsequence(part.tolist(), words.tolist()) / len(part)) < COVER:
                    continue
                out.append((docs[of[w]], block.item[q], c, cover))
        return out


def matches(held: DataFrame, block: Block, space: np.ndarray) -> DataFrame:
    """Verified pairs of document and item."""
    sent = held.sparkSession.sparkContext.broadcast((block, space))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search(*sent.value)
        for b in batches:
            yield pd.DataFrame(search.found(b["doc"].tolist(), _texts(b)), columns=["doc", "item_id", "cosine", "cover"])

    return held.mapInPandas(verify, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` (see ``key_of``), ``doc_id, item_ids`` (ascending), ``cosine``, ``cover`` (best) of the documents that hold an item."""
    short_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(key_of(doc_id, text).alias("doc"), F.col(f"`{text}`").alias("text"))
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").dropDuplicates().orderBy("item_id", "text")
    found, read = None, []
    for group in bounded(((int(r["item_id"]), part) for r in items.toLocalIterator() for part in cut(words_of(r["text"]))), GROUP):
        terms = Terms(np.unique(np.concatenate([w for _, w in group])))
        held = keep(numbered(docs, terms), "terms")
        read.append(held)
        df, total = frequencies(held, len(terms.words))
        for own in bounded(group, BLOCK):
            block = Block([(item, terms(w)) for item, w in own], df, total)
            pairs = matches(held, block, latent(held, block))
            found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    each = found.groupBy("doc", "item_id").agg(F.max("cosine").alias("cosine"), F.max("cover").alias("cover"))
    best = each.groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("cosine").alias("cosine"), F.max("cover").alias("cover"))
    out = keep(best.select("doc", F.when(~F.col("doc").startswith("t"), F.col("doc").try_cast("long")).alias("doc_id"), "item_ids", "cosine", "cover"), "contaminated")
    drop(*read)
    return out
