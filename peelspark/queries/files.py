"""Readers and writers as round trips through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import edges as src
from ..sources import sinks
from ..store import new_path
from .base import register


def _text(df: DataFrame, lines, *more: str) -> str:
    """A text file of the rows' lines, with further lines."""
    path = new_path(df.sparkSession, "text")
    extra = df.sparkSession.createDataFrame([(m,) for m in more], "value string")
    df.select(lines.alias("value")).unionAll(extra).write.text(path)
    return path


def _saved(df: DataFrame, write) -> str:
    path = new_path(df.sparkSession, "saved")
    write(df, path)
    return path


def autosep(e: DataFrame) -> DataFrame:
    path = _text(e, F.concat_ws(",", "src", "dst"))
    return src.read_edges(e.sparkSession, path).select(F.col("src").cast("long"), F.col("dst").cast("long"))


def props(e: DataFrame) -> DataFrame:
    spark, path = e.sparkSession, new_path(e.sparkSession, "props")
    e.select("dst", "src", "quantity").toDF("Target", "Source", "quantity").write.csv(path, header=True)
    return src.read_edges(spark, path, {"quantity": "long"}, "quantity > 10").select(F.col("src").cast("long"), F.col("dst").cast("long"), "quantity")


def deleted(e: DataFrame) -> DataFrame:
    path = _saved(e, lambda d, p: sinks.write_table(d, p))
    return e.sparkSession.createDataFrame([(sinks.delete(e.sparkSession, path), sinks.delete(e.sparkSession, path))], "first boolean, second boolean")


def exported(e: DataFrame, labels: DataFrame) -> DataFrame:
    path = _saved(e, lambda d, p: sinks.export_selection(d, labels, p))
    return e.sparkSession.read.csv(f"{path}/labels", header=True).select(F.col("new_id").cast("long").alias("new_id"), "name")


PAIRS = "SELECT src, dst FROM edges"
register("O-src-edgelist", "edges", lambda e: src.read_edge_list(e.sparkSession, _text(e, F.concat_ws("\t", "src", "dst", F.when(F.col("src") % 3 > 0, F.lit("0.5\tx"))))), PAIRS)  # two to four columns
register("O-src-comment", "edges", lambda e: src.read_edge_list(e.sparkSession, _text(e, F.concat_ws("\t", "src", "dst"), "# a note", "")), PAIRS)
register("O-src-autosep", "edges", autosep, PAIRS)
register("O-src-paren", "edges", lambda e: src.read_edges(e.sparkSession, _text(e, F.concat(F.lit("("), F.concat_ws(",", "src", "dst"), F.lit(")")))).select(F.col("src").cast("long"), F.col("dst").cast("long")), PAIRS)
register("O-src-edgeprops", "priced", props, "SELECT src, dst, quantity FROM priced WHERE quantity > 10")
register("O-src-vertices", "vertices labels_v", lambda v, l: src.read_vertices(v.sparkSession, _saved(v, lambda d, p: d.write.csv(p, header=True)), {"value": "long"}, "value > 5", l.select("id")).select(F.col("id").cast("long").alias("id"), "value"), "SELECT id, value FROM vertices WHERE value > 5 AND id IN (SELECT id FROM labels_v)")
register("O-src-json", "lccs", lambda c: src.read_json(c.sparkSession, _saved(c, lambda d, p: d.write.json(p, compression="gzip")), "layer long, lcc long, v long, e long"), "SELECT layer, lcc, v, e FROM lccs")
register("O-snk-csv-json", "lccs", lambda c: c.sparkSession.read.schema("lcc long, v long, layer long").json(_saved(c.select("lcc", "v", "layer"), lambda d, p: sinks.write_table(d, p, "json", ["layer"]))), "SELECT lcc, v, layer FROM lccs")
register("O-snk-props", "vertices", lambda v: v.sparkSession.read.schema("id long, value long").json(f"{_saved(v.select('id', 'value'), sinks.write_properties)}/value"), "SELECT id, value FROM vertices")
register("O-snk-metagraph", "lccs edges", lambda c, e: c.sparkSession.read.parquet(f"{_saved(c, lambda d, p: sinks.write_metagraph(d, e, p))}/E"), PAIRS)
register("O-snk-save-custom", "lccs", lambda c: sinks.saved_or(c.sparkSession, new_path(c.sparkSession, "custom"), "sizes", lambda: c.groupBy("layer").agg(F.count("*").alias("n"))), "SELECT layer, count(*) AS n FROM lccs GROUP BY layer")
register("O-snk-export", "edges labels_v", exported, "SELECT id AS new_id, label AS name FROM labels_v")
register("O-snk-delete", "lccs", deleted, 'SELECT true AS "first", false AS "second"')
