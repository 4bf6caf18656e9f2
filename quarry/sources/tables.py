"""Tables in Parquet, and sinks that replace a table as a whole."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _place(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


#: Paths written in the scopes that are open, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if (context.master or "").partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path; it goes with the session, or before by ``removed``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    files, place = _place(spark, path)
    files.delete(place, True)


def materialized(df: DataFrame, outer: bool = False) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder, its lineage cut.

    Unlike after a checkpoint, its size is known to the optimizer as it is: a loop's
    estimates don't multiply. The table goes when the ``scope`` around it ends (with
    ``outer``, the scope around that one), at the latest with the session.
    """
    out, path = written_at(df)
    scopes = _scopes.get()[: -1 if outer else None]
    if scopes:
        scopes[-1].append(path)
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at its end."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            removed(spark, path)


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace a table as a whole: the new files are written beside it and then take its name.

    A write that fails leaves the table as it is. Between the two renames there is a
    moment without a table; a store that can't rename folders copies instead.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, former = f"{path}.new-{mark}", f"{path}.old-{mark}"
    df.write.partitionBy(*partition_by).parquet(fresh)
    files, place = _place(spark, path)
    if files.exists(place):
        files.rename(place, _place(spark, former)[1])
    files.rename(_place(spark, fresh)[1], place)
    files.delete(_place(spark, former)[1], True)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _manifests(spark: SparkSession, root: str) -> dict[int, str]:
    """The manifests of ``root`` by number."""
    files, place = _place(spark, f"{root}/manifests")
    if not files.exists(place):
        return {}
    names = [f.getPath().getName() for f in files.listStatus(place)]
    return {int(n.removesuffix(".json")): f"{root}/manifests/{n}" for n in names if n.endswith(".json")}


def _content(spark: SparkSession, path: str) -> dict[str, str]:
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def published(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of ``root`` as one ``publish_all`` left them: the last one, or that of ``version``."""
    known = _manifests(spark, root)
    if not known:
        return {}
    return {name: spark.read.parquet(f"{root}/{folder}") for name, folder in _content(spark, known[max(known) if version is None else version]).items()}


def publish_all(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Replace several tables of ``root`` at once, and leave the others as they are; the new version's number.

    Each table is written to a folder of its own. A manifest then names the folders of
    all tables and takes its number by one rename, so that readers see all of the new
    tables or none, at any moment; a write that fails leaves everything as it is. If
    someone else took the number first, nothing is published and an error says so.
    """
    known = _manifests(spark, root)
    last = max(known, default=0)
    folders = _content(spark, known[last]) if known else {}
    for name, df in tables.items():
        folders[name] = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{folders[name]}")
    fresh = f"{root}/manifests/.new-{uuid.uuid4().hex}"
    files, place = _place(spark, fresh)
    out = files.create(place, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    target = _place(spark, f"{root}/manifests/{last + 1:08d}.json")[1]
    if files.exists(target) or not files.rename(place, target):
        files.delete(place, False)
        raise RuntimeError(f"version {last + 1} of {root} was published by someone else")
    return last + 1


def expired(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes manifests before the last ``keep`` and folders that only they name; the folders."""
    known = _manifests(spark, root)
    stay = sorted(known)[-keep:]
    used = {f for n in stay for f in _content(spark, known[n]).values()}
    gone = {f for n in known if n not in stay for f in _content(spark, known[n]).values()} - used
    for path in [*(known[n] for n in known if n not in stay), *(f"{root}/{f}" for f in sorted(gone))]:
        removed(spark, path)
    return sorted(gone)
