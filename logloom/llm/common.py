"""What the operators of this folder share: tables in the shared folder, and names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

T = TypeVar("T")

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one in the warehouse where it is unset.

    A path without a scheme is one of the default file system.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString().rstrip("/")
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage: a lost executor costs no more than the tasks that ran on it.
    """
    path = new_folder(df.sparkSession, name)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: For each open :func:`scratch` the tables written within.
_OPEN: list[list[str]] = []


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Removes the files of a result of :func:`table` that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end the tables written within it, but for those it is told to keep.

    What is kept must be a result of :func:`table`, so that nothing removed is read again.
    """
    made: list[str] = []
    kept_names: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept_names.update(f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles())
        return df

    _OPEN.append(made)
    try:
        yield keep
    finally:
        _OPEN.pop()
        for folder in made:
            if folder.rpartition("/")[2] not in kept_names:
                _remove(spark, folder)
            elif _OPEN:
                _OPEN[-1].append(folder)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its name, whatever signs the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0))


_KEPT: list = []


def kept(owner: object, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once by each Python worker for as long as it works for ``owner``, a broadcast value.

    Spark gives a worker one task after another, and what is made (an encoder and what it
    has encoded) is of bounded size and changes no result.
    """
    if not _KEPT or _KEPT[0] is not owner:
        forget_kept()  # before the new one is made, so that a worker never holds two
        _KEPT[:] = [owner, make()]
    return _KEPT[1]


def forget_kept() -> None:
    """Frees what :func:`kept` has left in this Python worker; for tasks that make nothing of the kind themselves."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def sent_once(docs: DataFrame) -> bool:
    """Whether ``text`` is what operators read of it, so that a row that travels along needs no second copy."""
    return docs.columns.count("text") == 1 and docs.schema["text"].dataType == StringType()


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``most`` bytes of ``column``; rows stay whole."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)
