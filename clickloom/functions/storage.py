"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_ONE = threading.Lock()
#: Folders to delete when the driver ends.
_LAST: list[str] = []
#: Folders to delete at the end of each open ``scratch``, the innermost last. Threads have a stack of their own.
_HELD: ContextVar[tuple[list[str], ...]] = ContextVar("held", default=(_LAST,))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own where none is set and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        with _ONE:
            root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='spark-clickloom-')}"
            spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, label: str, keep: bool = False, **options: str) -> DataFrame:
    """``df`` as a table of the shared folder, read back: cuts the plan and survives lost executors.

    It is deleted at the end of the ``scratch`` around it, or with ``keep`` of the one around that.
    """
    return written_at(df, label, keep, **options)[0]


def written_at(df: DataFrame, label: str, keep: bool = False, **options: str) -> tuple[DataFrame, str]:
    """``written``, and the table's folder for ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/clickloom/{label}-{uuid.uuid4().hex}"
    held = _HELD.get()
    held[max(0, len(held) - 2) if keep else -1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(path: str) -> None:
    """Delete a table that nothing reads any more."""
    _delete([path])
    for folders in _HELD.get():
        if path in folders:
            folders.remove(path)


def written_together(frames: dict[str, Callable[[], DataFrame]], at_once: int = 8) -> list[DataFrame]:
    """``written`` for independent frames, ``at_once`` at a time; their jobs share the cluster."""
    with ThreadPoolExecutor(at_once) as pool:  # each thread writes for the scratch of this one
        return list(pool.map(lambda x: x[0].run(lambda: written(x[1][1](), x[1][0])), [(copy_context(), x) for x in frames.items()]))


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those to ``keep``."""
    mine: list[str] = []
    token = _HELD.set((*_HELD.get(), mine))
    try:
        yield
    finally:
        _HELD.reset(token)
        _delete(mine)


def _delete(paths: list[str]) -> None:
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None:
        return
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(lambda: _delete(_LAST))
