"""Inputs that the queries share, as SQL both engines read, and the registry."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents".split()
FAR = 1_000_000_000_000

#: Graphs and stand-ins for the tables of a hierarchy, each over whole tables.
VIEWS = {
    # orders and their parts: sparse, many small cores
    "edges": f"SELECT DISTINCT l_orderkey AS src, {FAR} + l_partkey AS dst FROM {{lineitem}}",
    # as it comes: repeated, in both directions, with self loops
    "raw_edges": f"SELECT l_orderkey AS src, {FAR} + l_partkey AS dst FROM {{lineitem}} UNION ALL SELECT {FAR} + l_partkey, l_orderkey FROM {{lineitem}} UNION ALL SELECT o_orderkey, o_orderkey FROM {{orders}}",
    # customers and their orders: a forest of stars
    "forest": f"SELECT o_custkey AS src, {FAR} + o_orderkey AS dst FROM {{orders}}",
    "forest_parts": f"SELECT o_custkey AS id, o_custkey AS component FROM {{orders}} UNION SELECT {FAR} + o_orderkey, o_custkey FROM {{orders}}",
    # parts and suppliers: dense
    "layered": f"SELECT l_partkey AS src, {FAR} + l_suppkey AS dst, CAST(min(l_linenumber) AS BIGINT) AS layer FROM {{lineitem}} GROUP BY l_partkey, l_suppkey",
    "vertices": f"SELECT o_orderkey AS id, o_totalprice AS price, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS value FROM {{orders}} UNION ALL SELECT {FAR} + p_partkey, p_retailprice, CAST(p_size AS BIGINT) FROM {{part}}",
    "priced": f"SELECT l_orderkey AS src, {FAR} + l_partkey AS dst, CAST(max(l_quantity) AS BIGINT) AS quantity, CAST(min(l_linenumber) AS BIGINT) AS value FROM {{lineitem}} GROUP BY l_orderkey, l_partkey",
    "labels_v": f"SELECT {FAR} + p_partkey AS id, p_name AS label FROM {{part}} WHERE p_size > 10",
    "members": "SELECT DISTINCT l_partkey AS vertex, CAST(1 AS BIGINT) AS cc, CAST(l_linenumber AS BIGINT) AS layer, l_suppkey AS lcc FROM {lineitem}",
    "lccs": "SELECT CAST(l_linenumber AS BIGINT) AS layer, l_suppkey AS lcc, count(DISTINCT l_partkey) AS v, count(*) AS e, CAST(min(l_suppkey) AS BIGINT) % 3 AS bucket FROM {lineitem} GROUP BY l_linenumber, l_suppkey",
    "wedges": f"SELECT l_orderkey AS src, {FAR} + l_partkey AS dst, CAST(min(l_linenumber) AS BIGINT) AS wave, CAST(min(floor(l_quantity / 10)) AS BIGINT) AS frag, min(l_suppkey) AS wcc FROM {{lineitem}} GROUP BY l_orderkey, l_partkey",
    "wsources": "SELECT src AS id, min(wave) AS wave, min(frag) AS frag FROM {wedges} GROUP BY src UNION ALL SELECT dst, max(wave), max(frag) FROM {wedges} GROUP BY dst",
    "levels": "SELECT id, wave, frag, CAST(dense_rank() OVER (ORDER BY wave, frag) - 1 AS BIGINT) AS level FROM {wsources}",
    "arcs": "SELECT CASE WHEN a.level > b.level THEN e.dst ELSE e.src END AS src, CASE WHEN a.level > b.level THEN e.src ELSE e.dst END AS dst, least(a.level, b.level) AS ls, greatest(a.level, b.level) AS lt, CASE WHEN a.level > b.level THEN b.wave ELSE a.wave END AS ws, CASE WHEN a.level > b.level THEN a.wave ELSE b.wave END AS wt, e.wave, e.wcc FROM {wedges} e JOIN {levels} a ON e.src = a.id JOIN {levels} b ON e.dst = b.id",
    "steps": "SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS src, CAST(10 + l_linenumber AS BIGINT) AS dst FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey UNION SELECT DISTINCT CAST(10 + a.l_linenumber AS BIGINT), CAST(10 + b.l_linenumber AS BIGINT) FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 UNION SELECT DISTINCT CAST(10 + l_linenumber AS BIGINT), CAST(100 + floor(l_quantity / 10) AS BIGINT) FROM {lineitem}",
    "step_levels": "SELECT src AS id, CASE WHEN src < 10 THEN CAST(0 AS BIGINT) ELSE src - 10 END AS level FROM (SELECT src FROM {steps} UNION SELECT dst FROM {steps}) u",
    # meta nodes: one for a supplier and line number, links along orders
    "nodes": "SELECT l_suppkey * 10 + l_linenumber AS node, CAST(l_linenumber AS BIGINT) AS level, l_suppkey AS wcc, CAST(count(DISTINCT l_partkey) AS BIGINT) AS v, count(*) AS e, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS touch FROM {lineitem} GROUP BY l_suppkey, l_linenumber",
    "links": "SELECT a.l_suppkey * 10 + a.l_linenumber AS src, b.l_suppkey * 10 + b.l_linenumber AS dst, count(*) AS e FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY a.l_suppkey, a.l_linenumber, b.l_suppkey, b.l_linenumber",
    "floors": "SELECT l_suppkey AS lcc, CAST(l_linenumber AS BIGINT) AS wave, count(DISTINCT l_partkey) AS s, count(*) AS ss, count(DISTINCT l_orderkey) AS t, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS ie, CAST(sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS BIGINT) AS ee, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS e_next FROM {lineitem} GROUP BY l_suppkey, l_linenumber",
    "buildings": "SELECT s.s_suppkey AS building, s.s_suppkey % 8 AS bucket, count(DISTINCT l_partkey) AS v, count(*) AS e, max(l_quantity) AS height, count(DISTINCT l_linenumber) AS floors, sum(l_tax) AS road FROM {supplier} s JOIN {lineitem} ON s.s_suppkey = l_suppkey GROUP BY s.s_suppkey",
    "positions": "SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal / 100 AS y FROM {supplier}",
    "sets_v": "SELECT DISTINCT l_partkey AS id, CAST(l_linenumber AS STRING) AS set_id FROM {lineitem}",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def inputs(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """DataFrames of tables and views."""
    known: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in known:
            if name in TABLES:
                known[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            else:
                known[name] = spark.sql(VIEWS[name], **{n: get(n) for n in set(re.findall(r"\{(\w+)\}", VIEWS[name]))})
        return known[name]

    return {n: get(n) for n in names}


def with_views(sql: str) -> str:
    """SQL with the views it names in front."""
    order: list[str] = []

    def need(text: str, braces: bool) -> None:
        for n in VIEWS:
            if re.search(rf"\{{{n}\}}" if braces else rf"\b{n}\b", text) and n not in order:
                need(VIEWS[n], True)
                order.append(n)

    need(sql, False)
    views = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in order]
    if not views:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(views)}, {sql[15:]}"
    return f"WITH {', '.join(views)}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {', '.join(views)} {sql}"


def register(name: str, names: str, fn: Callable[..., DataFrame], sql: str | None = None) -> None:
    """A query over the named inputs, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(*inputs(spark, sf_dir, names.split()).values())

    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(" ".join(sql.split()))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines agree on the last bits."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
