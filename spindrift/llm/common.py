"""Helpers shared by the text operators: shared storage, Arrow batches, span arithmetic."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id in join keys; nulls order before every id.
NULL_ID = -(2**63)

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where the session names none, a local master
    gets a temporary folder, since its executors are the driver; a cluster is an error."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    global _own_dir
    try:
        return _own_dir
    except NameError:
        _own_dir = tempfile.mkdtemp(prefix="spindrift-")
        return _own_dir


#: Rows of a file of narrow rows; fewer files than FEW are not asked for, so that tasks stay several.
FILE_ROWS, FEW = 1 << 20, 4


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.
    ``rows``: about how many there are, where that is known; then as few files as that takes are written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(FEW, -(-rows // FILE_ROWS)))).write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage now, so that shuffle files of finished, written steps leave the disks."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what operators wrote to the shared folder inside it: results must be written or collected
    before."""
    before = len(_written)
    try:
        yield
    finally:
        release(before)


def release(keep: int = 0) -> None:
    """Delete what :func:`materialise` wrote, but for the first ``keep``.  Frames that still read it become invalid.
    Runs at the end of the process for all that is left."""
    while len(_written) > keep:
        own, path = _written.pop()
        try:
            jvm = own.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(own.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: the folder's owner removes it
            return


atexit.register(release)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Keys with more than one row in so many are hot; there are at most this many of them.
HOT = 10_000


def join_sums(rows: DataFrame, sums: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``sums``, which has one row for each key and in ``n`` the number of its rows.

    Rows of hot keys meet their sums in a broadcast of at most HOT rows, where they lie; only the others are shuffled.
    """
    hot = F.col(n) * HOT > F.lit(total)
    mark = free_name(rows, "hot_key")
    marked = rows.join(F.broadcast(sums.filter(hot).select(*keys, F.lit(True).alias(mark))), keys, "left")
    few = rows.join(F.broadcast(sums.filter(hot)), keys)
    return few.unionByName(marked.filter(F.col(mark).isNull()).drop(mark).join(sums.filter(~hot), keys))


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def original_id(key: str = "dk") -> Column:
    return F.when(F.col(key) != NULL_ID, F.col(key))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def trim() -> None:
    """Gives memory that is free inside this worker back to the system, so that the next stage's workers find it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What a worker keeps between tasks, by operator, and how to let go of it.
resident: dict[str, Callable[[], None]] = {}


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column``, one row at least.  Lets go of what other
    operators than ``keep`` left in this worker, and after the last batch of memory that is free."""
    for name in [n for n in resident if n != keep]:
        resident.pop(name)()
        gc.collect()
        trim()
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        if values.nbytes <= limit:
            yield batch
            continue
        lengths = np.array([len(x) if x else 0 for x in values.cast(pa.binary()).to_pylist()], dtype=np.int64)
        part = (np.cumsum(lengths) - lengths) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(lo), int(hi - lo))
    trim()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans; overlapping and touching ones become one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return lo[first], hi[last]
