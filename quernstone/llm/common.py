"""What the training-data operators share: reading, hold-outs, lineage cuts and batch slicing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from ctypes import CDLL

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that a vectorised step holds at once; bounds a Python worker's memory.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows that no model learns from: crc32 of the id as text, remainder 0 (null id: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one of our own on a single machine
    (as in tests), and an error on a cluster, whose machines would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quernstone-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Rows of a file, where it is known how many there are at most.
FILE_ROWS = 50_000


def stored(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Cuts the lineage: written as Parquet to the shared folder and read again, so that a lost executor
    costs one stage and later jobs see the same rows. With a bound on the rows given, a small table is not spread
    over as many files as there are shuffle partitions."""
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(3 + most_rows // FILE_ROWS)
    path = f"{shared_dir(spark).rstrip('/')}/quernstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quernstone-" in path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(folder, True)


def slices(sizes: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with about `most` characters each, one row at least."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def single_threaded() -> None:
    """Spark runs one Python worker for a core; libraries must not start threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


_models: dict = {}


def tidy() -> None:
    """Gives freed memory of a Python worker back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def model[T](name: tuple, make: Callable[[], T]) -> T:
    """The one model that a Python worker holds. Workers outlive jobs, so what another operator left goes first."""
    if name not in _models:
        no_model()
        _models[name] = make()
        tidy()
    return _models[name]


def no_model() -> None:
    if _models:
        _models.clear()
        tidy()


#: Ids up to which joined_ids broadcasts them (8 bytes each, if integers).
BROADCAST_IDS = 1_000_000


def joined_ids(rows: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Join of wide rows with a stored table of ids (and a number each), without shuffling the rows while the ids are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)
