"""Folders that appear whole: written under a draft name and renamed."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Paths in ``folder`` whose name begins with ``prefix``, in order; none if there is no such folder."""
    files, root = _files(spark, folder), _path(spark, folder)
    if not files.exists(root):
        return []
    found = (s.getPath() for s in files.listStatus(root))
    return sorted(str(p) for p in found if p.getName().startswith(prefix))


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder; ``new`` must not be there."""
    files = _files(spark, new)
    if files.exists(_path(spark, new)) or not files.rename(_path(spark, old), _path(spark, new)):
        raise OSError(f"{old} cannot be renamed to {new}")


def delete(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def new_version(spark: SparkSession, folder: str, prefix: str, write: Callable[[str], None]) -> str:
    """What ``write`` puts into a draft folder, as a new version in ``folder``; later ones come later by name."""
    name = f"{int(time.time() * 1000):014d}-{uuid.uuid4().hex}"
    draft, done = f"{folder.rstrip('/')}/_draft-{name}", f"{folder.rstrip('/')}/{prefix}{name}"
    write(draft)
    rename(spark, draft, done)
    return done


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """What ``write`` puts into a draft beside ``path`` takes its place; until then, and if it fails, the old one stays."""
    path = path.rstrip("/")
    name = uuid.uuid4().hex
    write(f"{path}.draft-{name}")
    there = _files(spark, path).exists(_path(spark, path))
    if there:
        rename(spark, path, f"{path}.old-{name}")
    rename(spark, f"{path}.draft-{name}", path)
    if there:
        delete(spark, f"{path}.old-{name}")
