"""What the operators share: staged tables, size-checked broadcasts and row access to Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only white space that the operators know.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast up to so many rows of at most about 100 bytes; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

_shipped: set[str] = set()
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets a temporary one; on a
    cluster every machine would have its own, so there it is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="qspace-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_staged() -> None:
    for spark, path in _staged:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: its owner clears the shared folder
            return


atexit.register(_remove_staged)


def staged_count() -> int:
    return len(_staged)


def remove_staged(first: int, last: int) -> None:
    """Delete what was staged from number first to before number last; nothing that is still to be read may be among it."""
    for spark, path in _staged[first:last]:
        _remove(spark, path)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/qspace-{label}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_heaps(spark: SparkSession) -> int:
    """Every executor collects its Java garbage, so that the heap shrinks to a few times what is live and leaves room for Python workers;
    twice, as what waits for a reference to be cleared goes the second time. As many one-row tasks as there are executors: idle ones get
    one each. Returns that number."""
    sc = spark.sparkContext
    executors = max(1, len(sc._jsc.sc().statusTracker().getExecutorInfos()) - 1)  # the driver is among them
    collect = "java_method('java.lang.System', 'gc')"
    return len(spark.range(0, executors, 1, executors).selectExpr(f"{collect} AS once", f"{collect} AS twice").collect())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, which should be staged, has at most so many rows."""
    return df.count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver imported it from; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="qspace-code-")) / "qspace.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(target))


#: Modules whose workers remember things, with the cached function that holds them. A worker serves many tasks and keeps one module's memory.
MEMORIES: dict[str, Any] = {}


def _give_back() -> None:
    """Memory that is free goes back to the system, as other processes share it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def _forget(keep: str) -> None:
    for module, cached in MEMORIES.items():
        if module != keep and cached.cache_info().currsize:
            cached.cache_clear()
            gc.collect()  # what was held refers to itself
            _give_back()


def _released(run: Callable) -> Callable:
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget(run.__module__)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow() whose workers give back what earlier tasks of other operators hold."""
    ship(df.sparkSession)
    return df.mapInArrow(_released(run), schema)


def records(batch, *names: str) -> Iterator[tuple]:
    """Rows of an Arrow batch, one at a time, so that only one long text is a Python object at once."""
    columns = [batch.column(name) for name in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)
