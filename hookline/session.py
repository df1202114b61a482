"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "hookline",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on and the UI off.

    ``shuffle_partitions`` (or HOOKLINE_SHUFFLE_PARTITIONS) is set only if given;
    otherwise the cluster's own setting holds.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    parts = shuffle_partitions or os.environ.get("HOOKLINE_SHUFFLE_PARTITIONS")
    if parts:
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    b = (b.config("spark.driver.memory", os.environ.get("HOOKLINE_DRIVER_MEMORY", "16g"))
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used when the cluster sets
    it; a fresh local folder is made only where nothing is configured and the
    master is local (tests, a laptop). On a cluster that is an error, as
    executors would write to their own disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0] if _looks_like_uuid(current.rsplit("/", 1)[-1]) else current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="hookline-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def _looks_like_uuid(s: str) -> bool:
    try:
        uuid.UUID(s)
        return True
    except ValueError:
        return False


class ScratchScope:
    """Scratch paths handed out while a scope is active; all but the kept ones are dropped at its end."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, path: str) -> None:
        self.kept.add(path)


_scope: ContextVar[ScratchScope | None] = ContextVar("hookline_scratch", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[ScratchScope]:
    """Drop the intermediate tables of what runs inside, once its result is written.

    DataFrames built inside read those tables, so consume them before the scope ends. An inner
    scope leaves what it keeps to the outer one. A pool's threads take part if
    their calls go through ``in_this_scope``.
    """
    scope, outer = ScratchScope(), _scope.get()
    token = _scope.set(scope)
    try:
        yield scope
    finally:
        _scope.reset(token)
        for path in scope.paths:
            if path in scope.kept:
                if outer is not None:
                    outer.paths.append(path)
            else:
                drop_path(spark, path)


def in_this_scope(fn: Callable) -> Callable:
    """``fn`` for a pool's threads: its scratch paths belong to the scope that is active here."""
    here = copy_context()
    return lambda *a, **k: here.copy().run(fn, *a, **k)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/hookline-{name}-{uuid.uuid4().hex[:12]}"
    scope = _scope.get()
    if scope is not None:
        scope.paths.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that no table reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
