"""What the operators of this subpackage share: tables, shared scratch folders, grouped streams."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local run makes one of its own; a cluster run stops,
    as a machine-local folder would lose data there.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='cohortspark-')}")
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables of one run, written under the shared folder; they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: list[str] = []

    def save(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes saved tables that nothing will read again."""
        self._delete([df._scratch_path for df in tables])

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes all saved tables but these, which a result still reads."""
        kept = {df._scratch_path for df in tables}
        self._delete([path for path in self.paths if path not in kept])

    def _delete(self, paths: list[str]) -> None:
        for name in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = [path for path in self.paths if path not in set(paths)]


def _release() -> None:
    """Gives memory that is no longer used back to the machine; workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(f, schema)``, with the worker's memory released after each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cuts a stream sorted by integer ``keys`` between groups: (rows of whole groups, offsets of the groups)."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        edges = _edges(rows, keys)
        if edges[-1]:
            yield rows.slice(0, edges[-1]).combine_chunks(), edges
        rest = rows.slice(edges[-1])
    if rest is not None and rest.num_rows:
        edges = _edges(rest, keys)
        yield rest.combine_chunks(), np.append(edges, rest.num_rows)


def _edges(rows: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(rows.num_rows, dtype=bool)
    change[0] = True
    for key in keys:
        x = rows.column(key).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)
