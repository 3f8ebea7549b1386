"""Cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session that lacks it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="siftline-")
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# The types whose values a Parquet file gives back as they are.
_STORED = (
    T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


def _storable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    if isinstance(kind, T.StructType):
        names = {f.name.lower() for f in kind}
        return 0 < len(names) == len(kind) and all(_storable(f.dataType) for f in kind)
    return isinstance(kind, _STORED)


def reliable(df: DataFrame) -> DataFrame:
    """The rows written once into the shared folder and read from there, each reader taking the columns it needs.

    ``checkpoint()`` computes the rows twice, to count and to write them, and always reads them whole; it is left for types
    that files do not hold. Columns are numbered in the files, so that they may have any names.
    """
    names, kinds = df.columns, [f.dataType for f in df.schema]
    if not names or not all(_storable(k) for k in kinds):
        context = df.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_folder(df.sparkSession))
        return df.checkpoint()
    path = new_path(df.sparkSession, "rows")
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    numbered.write.parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path).toDF(*names)
