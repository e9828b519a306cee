"""Fitting a model in one executor task, so that of a training sample only the model reaches the driver."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..store import drop, keep


class Spool(Sequence):
    """Arrays in the task's scratch file, read back by place, so that memory doesn't grow with the rows or their lengths."""

    def __init__(self, dtype) -> None:
        self.file, self.dtype, self.ends = tempfile.TemporaryFile(), np.dtype(dtype), [0]

    def append(self, raw: bytes) -> None:
        self.file.write(raw)
        self.ends.append(self.ends[-1] + len(raw))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        self.file.seek(self.ends[i])
        return np.frombuffer(self.file.read(self.ends[i + 1] - self.ends[i]), self.dtype)


def fitted(sample: DataFrame, order: list[str], arrays: dict[str, str], labels: list[str], fit: Callable[..., list[tuple]], result: str) -> list:
    """The rows (schema ``result``) that ``fit(labels, **arrays)`` makes of a bounded sample, sorted by ``order``.

    ``arrays`` maps binary columns to the type of their numbers; they are handed
    over as ``Spool``, the ``labels`` columns as a data frame.  The sample is a
    table before one task reads it, so that its making stays distributed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spools, seen = {c: Spool(t) for c, t in arrays.items()}, []
        for b in batches:
            seen.append(b[labels])
            for c, spool in spools.items():
                for raw in b[c]:
                    spool.append(raw)
        got = pd.concat(seen, ignore_index=True) if seen else pd.DataFrame({c: [] for c in labels})
        yield pd.DataFrame(fit(got, **spools), columns=[f.split()[0] for f in result.split(", ")])

    held = keep(sample, "sample")
    out = held.repartition(1).sortWithinPartitions(*order).select(*labels, *arrays).mapInPandas(run, result).collect()
    drop(held)
    return out
