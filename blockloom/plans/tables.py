"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: For each thread, the tables written in each of its tidy calls under way.
under_way: dict[int, list[list[str]]] = {}


def removed(spark: SparkSession, path: str) -> None:
    if path.startswith("file://"):
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        return
    with contextlib.suppress(Exception):  # the cluster may be gone by now
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where Spark runs in this process alone, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them can reach")
    return f"file://{tempfile.gettempdir()}/blockloom-tables"


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when the program ends."""
    path = f"{shared_folder(spark)}/blockloom-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    if calls := under_way.get(threading.get_ident()):
        calls[-1].append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from Parquet: computed once, whatever reads them, and safe from lost executors. The table goes when the program ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; looks at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def read_by(df: DataFrame) -> set[str]:
    """The last parts of the paths that a DataFrame reads."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            found |= {paths.apply(k).getName() for k in range(paths.size())}
    return found


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose tables go as soon as it returns, but for those that the DataFrame it returns reads; they stay for the caller's caller."""

    @functools.wraps(f)
    def run(*args, **options) -> DataFrame:
        calls = under_way.setdefault(threading.get_ident(), [])
        made: list[str] = []
        calls.append(made)
        try:
            out = f(*args, **options)
        finally:
            calls.pop()
        used = read_by(out)
        for path in made:
            if path.rsplit("/", 1)[-1] not in used:
                removed(out.sparkSession, path)
            elif calls:
                calls[-1].append(path)
        return out

    return run
