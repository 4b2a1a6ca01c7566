"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to one vectorised step inside a task, in characters.
STEP_CHARS = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()
#: Bytes of a batch that goes to a Python worker, where the session doesn't say (texts may be long).
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow; executors get this package's code from the driver."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Workers live on between stages: what a task no longer uses goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Once for an application: the package's code for the executors, and batches of bounded size."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="tablelens-code-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)


def quoted(name: str) -> str:
    """The name as SQL takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def named(df: DataFrame, name: str) -> Column:
    """The column of that very name (dots are part of it)."""
    return df[quoted(name)]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(quoted(name)), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that the table doesn't have (nor one that differs by case only)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def steps(texts: list[str], chars: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about `chars` characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of flat[s:s+n] for each (s, n)."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    shift = starts.astype(np.int64)
    shift[1:] -= np.cumsum(lens[:-1])
    return flat[np.repeat(shift, lens) + np.arange(total)]


def offsets(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out
