"""N-gram Jaccard join over count vectors.

A document is the set of its distinct word shingles.  The set's tokens are
hashed into ``GROUPS`` groups and their counts make the document a point; two
documents share at most the sum over the groups of the smaller counts, so a
pair can only be similar if that sum reaches the overlap that the threshold
asks for.  Points are searched in packed R-trees whose nodes hold the largest
counts and the range of sizes below them: a subtree is left out if even its
largest counts cannot reach the overlap.  Surviving pairs are bounded once more
over counts of about two tokens a group and then verified on the whole sets.

One tree over a corpus would end as a scan, since points of unrelated documents
of one size lie close together.  There is therefore a forest, a tree for each
bucket of a routing that loses no pair: all tokens have one global order, and
two similar sets share a token among the first ``n - ceil(t n) + 1`` of each.
Any order is correct; ours is by hash, with the tokens of large buckets moved
behind all others and the prefixes of the documents concerned taken anew, so
that common passages do not bring unrelated documents together.  At most
``MOVED`` tokens are moved; a bucket that stays large is cut into chunks and
every two chunks are joined apart, so that no task holds a bucket and no pair
is lost.

Documents with equal sets are one class from the start, with a number of its
own.  Each bucket first offers its least class with each other member; what
that links needs no more pairs inside the bucket, so groups of near copies are
never expanded.  Only buckets that still hold several components are searched by
tree, for pairs across components.

Null and empty texts have an empty set and link with nothing; a text of fewer
words than a shingle is one token; rows that share a ``doc_id`` are one vertex
of the link graph, whatever their texts (only those without words stay alone);
rows without a ``doc_id`` take the class's component and link with nothing else.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..store import drop, keep, sized
from .batches import short_batches
from .hashing import mix, text_shingles

GROUPS = 128
COUNT = np.dtype("<u2")
#: A bucket with more members than this has its token moved behind all others.
LARGE = 512
#: Members of a chunk of a bucket that stays larger.
CHUNK = 256
#: Tokens that may be moved; they are sent to every executor (8 bytes each).
MOVED = 1 << 20
ROUNDS = 3
#: One in so many documents is looked at for the first guess at common tokens; a token of three of them is one.
SAMPLE = 32
#: Points of a tree's leaf and children of its nodes.
LEAF = 16
#: Pairs whose counts are compared at once.
BLOCK = 32_768
POINT = "n long, s1 long, s2 long, counts binary, keys array<long>"
SIGNATURE = ["n", "s1", "s2"]


def need(a, b, percent: int):
    """Least overlap of sets of these sizes whose Jaccard similarity reaches ``percent``."""
    return -(-percent * (a + b) // (100 + percent))


def smaller(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bound of the tokens that points share: the sum of the smaller counts, or no bound where both are full."""
    shared = np.minimum(x, y).sum(-1, dtype=np.int64)
    return np.where(shared == GROUPS * np.iinfo(COUNT).max, 1 << 62, shared)


def signature(s: np.ndarray) -> tuple[int, int, int]:
    """Size and two sums that tell sets apart."""
    with np.errstate(over="ignore"):
        return len(s), *(int(x.view(np.int64)) for x in (s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)))


def points(docs: DataFrame, k: int, percent: int, moved: np.ndarray) -> DataFrame:
    """The columns of ``docs`` but ``text``, with size, signature, group counts and prefix of every row's set."""
    sent = docs.sparkSession.sparkContext.broadcast(moved)

    def make(texts: pd.Series) -> pd.DataFrame:
        back, rows = sent.value, []
        for text in texts:
            s = text_shingles(text, k)
            n = len(s)
            first = n - -(-percent * n // 100) + 1 if n else 0
            if len(back) and n:
                at = np.minimum(np.searchsorted(back, s), len(back) - 1)
                common = back[at] == s
                ordered = np.concatenate((s[~common], s[common]))
            else:
                ordered = s
            counts = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
            if n and counts.max() > np.iinfo(COUNT).max:  # then the bound leaves nothing out, see smaller()
                counts[:] = np.iinfo(COUNT).max
            rows.append((*signature(s), counts.astype(COUNT).tobytes(), ordered[:first].view(np.int64).copy()))
        return pd.DataFrame(rows, columns=[*SIGNATURE, "counts", "keys"])

    make.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    kept = [c for c in docs.columns if c != "text"]
    return docs.select(*kept, F.pandas_udf(make, POINT)("text").alias("point")).select(*kept, "point.*")


class CountTree:
    """A packed R-tree over count vectors, searched level by level for many points at once."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray) -> None:
        # packed by size, then by the fullest group
        self.order = np.lexsort((counts.argmax(1), sizes))
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > LEAF:
            most, low, high = self.levels[-1]
            at = np.arange(0, len(low), LEAF)
            self.levels.append((np.maximum.reduceat(most, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, counts: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, bound) of the pairs that may reach the overlap, by their places in the arrays given."""
        top = len(self.levels) - 1
        width = len(self.levels[top][1])
        q, node = np.repeat(np.arange(len(sizes)), width), np.tile(np.arange(width), len(sizes))
        for depth in range(top, -1, -1):
            most, low, high = self.levels[depth]
            q, node, bound = fitting(q, node, counts, sizes, most, low, high, percent)
            if depth:
                width = len(self.levels[depth - 1][1])
                q, node = np.repeat(q, LEAF), (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                q, node = q[node < width], node[node < width]
        return q, self.order[node], bound


def fitting(q: np.ndarray, node: np.ndarray, counts: np.ndarray, sizes: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of query and node that the range of sizes and the summed smaller counts leave, with that sum."""
    size = sizes[q]
    fits = (percent * low[node] <= 100 * size) & (100 * high[node] >= percent * size)
    q, node, size = q[fits], node[fits], size[fits]
    bound = np.concatenate([np.zeros(0, np.int64), *(smaller(most[node[i : i + BLOCK]], counts[q[i : i + BLOCK]]) for i in range(0, len(q), BLOCK))])
    # a smaller partner asks for the least overlap
    fits = bound >= need(size, np.maximum(low[node], -(-percent * size // 100)), percent)
    return q[fits], node[fits], bound[fits]


def bucket_pairs(starts: np.ndarray, ends: np.ndarray, second: np.ndarray, parts: np.ndarray, counts: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bound) of the rows of different ``parts`` that may be similar inside each group of rows; each group's tree holds the rows from ``second`` on, asked for by those before, or by all if there are none."""
    found = []
    lone = second == starts
    # groups of a single leaf need no tree: their pairs are compared together
    small = lone & (ends - starts <= LEAF)
    n = (ends - starts)[small]
    i = np.concatenate([np.zeros(0, np.int64), *(np.repeat(np.arange(a, b), b - a) for a, b in zip(starts[small], ends[small], strict=True))])
    j = np.concatenate([np.zeros(0, np.int64), *(np.tile(np.arange(a, b), b - a) for a, b in zip(starts[small], ends[small], strict=True))]) if len(n) else i
    fits = (i < j) & (parts[i] != parts[j])
    found.append(fitting(i[fits], j[fits], counts, sizes, counts, sizes, sizes, percent))
    for a, b, c, own in zip(starts[~small], ends[~small], second[~small], lone[~small], strict=True):
        tree = CountTree(counts[c:b], sizes[c:b])
        to = b if own else c
        q, p, bound = tree.search(counts[a:to], sizes[a:to], percent)
        q, p = q + a, p + c
        fits = (q < p) & (parts[q] != parts[p])  # rows of a first chunk all stand before those of the second
        found.append((q[fits], p[fits], bound[fits]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _groups(batches: Iterator[pd.DataFrame], on: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of sorted batches."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b[on].iloc[-1]
        same = (b[on] == last).all(axis=1).to_numpy()
        if not same.all() or rest and not (rest[-1][on].iloc[-1] == last).all():
            cut = int((~same).sum())
            yield pd.concat([*rest, b.iloc[:cut]], ignore_index=True)
            rest = []
            b = b.iloc[cut:].reset_index(drop=True)
        rest.append(b)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def tree_pairs(members: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of different components of ``members(key, cid, component, n, counts)`` that share a bucket and survive the bound, each once; with ``best`` only each one's likeliest partner in a bucket."""
    group = ["key", "c1", "c2"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _groups(batches, group):
            ids, parts, sizes = (b[c].to_numpy() for c in ("cid", "component", "n"))
            counts = np.frombuffer(b"".join(b["counts"]), COUNT).reshape(-1, GROUPS)
            where = b[group].to_numpy()
            edge = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(b)]))
            other = (b["own"] != b["c1"]).to_numpy()
            of_first = np.add.reduceat(~other, starts)
            second = np.where((b["c1"] == b["c2"]).to_numpy()[starts], starts, starts + of_first)
            i, j, bound = bucket_pairs(starts, ends, second, parts, counts, sizes, percent)
            if best and len(i):
                likely = bound / (sizes[i] + sizes[j])
                q, p, likely = np.concatenate((i, j)), np.concatenate((j, i)), np.tile(likely, 2)
                order = np.lexsort((ids[p], -likely, q))
                order = order[np.concatenate(([True], q[order][1:] != q[order][:-1]))]
                i, j = q[order], p[order]
            pairs = np.unique(np.sort(np.stack((ids[i], ids[j]), 1), axis=1), axis=0)
            yield pd.DataFrame(pairs, columns=["a", "b"])

    return dealt(members).sortWithinPartitions(*group, "own").mapInPandas(search, "a long, b long").distinct()


def dealt(members: DataFrame) -> DataFrame:
    """The members by the pair of chunks ``key, c1, c2`` in which they are joined; ``own`` is the member's chunk.

    Only pairs across components count, so a bucket beyond ``CHUNK`` is cut into
    the chunks of its fullest component, which meet those of all others but not
    each other, and the chunks of the others, of which every two meet.  A large
    group of near copies, all but a few linked, is dealt about once.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"))
    large = sizes.filter(F.col("all") > CHUNK).select("key", F.col("top.component").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / CHUNK).cast("int").alias("rest"), F.ceil(F.col("top.n") / CHUNK).cast("int").alias("tops"))
    placed = members.join(large, "key", "left")
    on_top, chance = F.col("component") == F.col("top"), F.xxhash64("cid")
    own = F.when(F.col("top").isNull(), 0).when(on_top, F.col("rest") + F.pmod(chance, F.col("tops"))).otherwise(F.pmod(chance, F.col("rest"))).cast("int")
    meets = F.when(F.col("top").isNull(), 1).when(on_top, F.col("rest")).otherwise(F.col("rest") + F.col("tops"))
    placed = placed.withColumns({"own": own, "meets": meets.cast("int")}).filter("meets > 0")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    placed = placed.withColumns({"c1": F.least("own", "other"), "c2": F.greatest("own", "other")})
    return placed.select("key", "c1", "c2", "own", "cid", "component", "n", "counts").repartition("key", "c1", "c2")


def shared_at_most(x: bytes, y: bytes) -> int:
    """Upper bound of the tokens two documents share, from their fine counts, the longer folded to the shorter."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if max(x.max(), y.max()) == 255:  # a byte did not hold the count
        return 1 << 62
    size = min(len(x), len(y))
    x, y = (c.reshape(-1, size).sum(0, dtype=np.int64) for c in (x, y))
    return int(np.minimum(x, y).sum())


class Sets:
    """Token sets and fine counts of the classes that some pair asks for; every text is fetched once."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, percent: int, again: bool) -> None:
        self.docs, self.classes, self.k, self.percent, self.again = docs, classes, k, percent, again
        self.held: DataFrame | None = None
        self.tables: list[DataFrame] = []

    def texts(self, ids: DataFrame) -> DataFrame:
        """``cid, n, s1, s2, text`` of the classes ``ids(cid)``, from the row that stands for each."""
        asked = sized(self.classes.join(ids, "cid", "left_semi").select("cid", *SIGNATURE, F.col("least").alias("doc_id"), "text_hash"), 64)
        got = self.docs.join(asked, ["doc_id", "text_hash"]).select("cid", *SIGNATURE, "text")
        return got.dropDuplicates(["cid"]) if self.again else got

    def fetch(self, ids: DataFrame) -> None:
        k = self.k
        if self.held is not None:
            ids = ids.join(self.held.select("cid"), "cid", "left_anti")

        def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for cid, *own, text in b.itertuples(index=False):
                    s = text_shingles(text, k)
                    if signature(s) == tuple(own):
                        groups = max(GROUPS, 1 << (len(s) // 2).bit_length())
                        fine = np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8)
                        rows.append((cid, len(s), fine.tobytes(), s.tobytes()))
                yield pd.DataFrame(rows, columns=["cid", "n", "fine", "tokens"])

        new = keep(self.texts(ids).mapInPandas(make, "cid long, n long, fine binary, tokens binary"), "token-sets")
        self.tables.append(new)
        self.held = new if self.held is None else self.held.unionByName(new)

    def joined(self, pairs: DataFrame, value: list[str]) -> DataFrame:
        """The pairs with ``value`` of both sides."""
        side = lambda x: self.held.select(F.col("cid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in value))
        few = sized(pairs, 32)
        ids = sized(pairs.select("a").distinct(), 32)
        return side("b").join(few, "b").join(side("a").join(ids, "a", "left_semi"), "a")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` whose whole sets reach the similarity."""
        percent = self.percent

        def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ok = [shared_at_most(x, y) >= need(m, n, percent) for x, y, m, n in zip(b["fine_a"], b["fine_b"], b["n_a"], b["n_b"], strict=True)]
                yield b.loc[ok, ["a", "b"]]

        def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ok = []
                for x, y in zip(b["tokens_a"], b["tokens_b"], strict=True):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield b.loc[ok, ["a", "b"]]

        pairs = keep(pairs, "pairs")
        self.fetch(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
        likely = keep(self.joined(pairs, ["n", "fine"]).mapInPandas(bound, "a long, b long"), "likely-pairs")
        links = keep(self.joined(likely, ["tokens"]).mapInPandas(check, "a long, b long"), "links")
        drop(pairs, likely)
        return links


def common_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """Tokens of several documents of a sample: a first guess at those of large buckets, which any order allows."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": np.concatenate([np.zeros(0, np.uint64), *(text_shingles(t, k) for t in b["text"])]).view(np.int64)})

    sample = docs.filter(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(SAMPLE)) == 0).dropDuplicates(["text"])
    often = sample.select("text").mapInPandas(sets, "key long").groupBy("key").count().filter(F.col("count") >= 3)
    return np.unique(often.orderBy(F.desc("count"), "key").limit(MOVED // 2).toPandas()["key"].to_numpy(np.int64).view(np.uint64))


def grown(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """``parts(id, component)`` after further links; the components are what the links join."""
    if parts is None:
        return keep(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "parts")
    now = links
    for x in "ab":
        now = now.join(parts.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")), x, "left")
    joined = keep(connected_components(now.select(F.coalesce("c_a", "a").alias("u"), F.coalesce("c_b", "b").alias("v"))), "joined")
    moved = joined.select(F.col("id").alias("component"), F.col("component").alias("to"))
    out = parts.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    after = keep(out.unionByName(joined.join(parts, "id", "left_anti")), "parts")
    drop(joined, parts)
    return after


def still_open(members: DataFrame, parts: DataFrame, light: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with these and their points."""
    placed = members.join(parts.withColumnRenamed("id", "cid"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("component"))
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return keep(placed.join(several, "key", "left_semi").join(light, "cid"), "open")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    short_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    spark = docs.sparkSession
    moved = common_tokens(docs, k)
    rows = keep(points(docs, k, percent, moved).withColumn("rid", F.monotonically_increasing_id()), "points")
    slim = keep(rows.select("doc_id", *SIGNATURE), "signatures")
    again = not rows.filter("n > 0").groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty()
    first = rows.filter("n > 0").groupBy(*SIGNATURE).agg(F.min("doc_id").alias("least"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.min_by("rid", "doc_id").alias("rid"))
    classes = keep(first.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # a class of rows without an id links with nothing
    linked = classes.filter("least IS NOT NULL")
    own = keep(rows.join(sized(linked.select("rid", "cid"), 32), "rid").select("cid", "n", "counts", "keys"), "class-points")
    drop(rows)
    sets = Sets(docs, linked, k, percent, again)

    for turn in range(ROUNDS + 1):
        shared = keep(own.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1"), "shared")
        if turn == ROUNDS:
            break
        sent = spark.createDataFrame(pd.DataFrame({"key": moved.view(np.int64)}), "key long")
        large = shared.filter(F.col("count") > LARGE).join(sent, "key", "left_anti")
        more = large.orderBy(F.desc("count"), "key").limit(MOVED - len(moved)).toPandas()["key"].to_numpy(np.int64)
        if not len(more):
            break
        moved = np.unique(np.concatenate((moved, more.view(np.uint64))))
        back = spark.createDataFrame(pd.DataFrame({"key": more}), "key long")
        touched = keep(own.select("cid", F.explode("keys").alias("key")).join(back, "key", "left_semi").select("cid").distinct(), "touched")
        anew = points(sets.texts(touched).select("cid", "text"), k, percent, moved).select("cid", "n", "counts", "keys")
        after = keep(own.join(sized(touched, 32), "cid", "left_anti").unionByName(anew), "class-points")
        drop(own, shared, touched)
        own = after

    filled = keep(own.select("cid", F.explode("keys").alias("key")).join(sized(shared.select("key"), 40), "key").select("key", "cid"), "filled")
    # buckets with the same members count once
    alike = filled.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.sum("cid").alias("total"), F.min("cid").alias("least"))
    buckets = keep(alike.groupBy("members", "x", "total").agg(F.min("key").alias("key"), F.min("least").alias("least")).select("key", "least"), "buckets")
    members = keep(filled.join(buckets, "key"), "members")
    light = keep(own.join(members.select("cid").distinct(), "cid", "left_semi").select("cid", "n", "counts"), "light")
    drop(own, shared, filled, buckets)

    stars = members.filter("least <> cid").groupBy("cid").agg(F.min("least").alias("a")).select("a", F.col("cid").alias("b"))
    of_a, of_b = (light.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"c_{x}")) for x in "ab")
    parts = grown(None, sets.verified(_bounded(stars.join(of_b, "b").join(of_a, "a"), percent)))
    # the likeliest partners first, so that groups of near copies are closed before all pairs that are left
    for best in (True, False):
        left = still_open(members, parts, light)
        parts = grown(parts, sets.verified(tree_pairs(left, percent, best)))
        drop(left)
    drop(members, light, *sets.tables)

    # rows that share an id join their classes
    of_rows = keep(slim.join(classes.select(*SIGNATURE, "cid"), SIGNATURE, "left").select("doc_id", "n", "cid"), "classes-of-rows")
    drop(slim)
    held = of_rows.filter("doc_id IS NOT NULL AND cid IS NOT NULL").groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).filter("a <> z")
    if not held.isEmpty():
        parts = grown(parts, held.join(of_rows.filter("cid IS NOT NULL"), "doc_id").filter("cid <> a").select("a", F.col("cid").alias("b")))
    placed = linked.join(parts.withColumnRenamed("id", "cid"), "cid", "left").select("cid", "least", F.coalesce("component", "cid").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    found = placed.join(smallest, "component").select("cid", "component_id")
    out = of_rows.join(found, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (with sizes and counts of both) whose summed smaller counts reach the overlap."""

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), COUNT).reshape(-1, GROUPS) for c in ("c_a", "c_b"))
                yield b.loc[smaller(x, y) >= need(b["n_a"], b["n_b"], percent).to_numpy(), ["a", "b"]]

    fits = (F.col("n_a") * percent <= F.col("n_b") * 100) & (F.col("n_b") * percent <= F.col("n_a") * 100)
    return pairs.filter(fits).select("a", "b", "n_a", "n_b", "c_a", "c_b").mapInPandas(bound, "a long, b long")
