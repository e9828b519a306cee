"""A folder of data sets: one edge file per name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..store import delete
from .edges import list_datasets, read_edges
from .sinks import write_edge_list

SEPARATORS = {"tsv": "\t", "csv": ",", "txt": " "}


@dataclass
class DataFolder:
    """The data sets below ``path``; another folder is another object."""

    spark: SparkSession
    path: str

    def names(self) -> DataFrame:
        """``name, kind`` of every data set; of files with one name the first of tsv, csv, txt counts."""
        return list_datasets(self.spark, self.path)

    def add(self, name: str, edges: DataFrame, kind: str = "tsv") -> None:
        """Write a data set; one that is there is not overwritten."""
        write_edge_list(edges, f"{self.path}/{name}.{kind}", sep=SEPARATORS[kind])

    def edges(self, name: str) -> DataFrame:
        found = [r["kind"] for r in self.names().filter(f"name = '{name}'").collect()]
        if not found:
            raise KeyError(name)
        return read_edges(self.spark, f"{self.path}/{name}.{found[0]}")

    def delete(self, name: str) -> bool:
        """Remove every file of a name; whether there was one."""
        return any([delete(self.spark, f"{self.path}/{name}.{kind}") for kind in SEPARATORS])
