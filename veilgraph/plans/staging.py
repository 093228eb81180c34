"""Cutting lineage through storage that every executor shares.

Iterative operators and multi-pass operators write what they have so far to
the cluster's shared folder, so that a lost executor costs a re-read and not
the whole history.  The folder is the one the session names in
``spark.checkpoint.dir``; only a local master without that setting (tests, a
notebook) gets a temporary one.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

_LOCK = threading.Lock()
_STAGED: list[str] = []
_SCOPES = threading.local()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITES: dict[int, list] = {}  # by session: writes under way, the setting before the first


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. On a local master one is made if the
    session names none; elsewhere that is an error, as executors could not
    read the driver's folders."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilgraph-"))
    return context.getCheckpointDir()


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While a write lasts, shuffle files go as soon as they are read; the
    session's own setting is back when the last of several writes ends."""
    key = id(spark._jsparkSession)
    with _LOCK:
        state = _WRITES.setdefault(key, [0, spark.conf.get(_CLEAN, "false")])
        state[0] += 1
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _LOCK:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(_CLEAN, state[1])
                del _WRITES[key]


def staged(df: DataFrame, name: str = "rows", partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    Columnar and compressed, so it suits wide or long intermediate tables
    that are read several times.  The shuffle files of the write go when it
    ends: nothing reads them again.  The table stays until drop() or
    drop_staged().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _cleaning(spark):
        writer.parquet(path)
    _STAGED.append(path)
    for scope in getattr(_SCOPES, "open", []):
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def steady_scans(spark: SparkSession) -> None:
    """From now on tables are split alike in every scan of the session.

    Spark cuts files by the number of cores that it has just now, so a lost
    executor could shift the rows of a later scan's partitions.  Operators
    that number rows by partition and read a table more than once pin it,
    unless the session has; results are read when the caller asks for them,
    so it stays pinned.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df, if it does no more than scan one stored table, project and filter;
    else a staged copy. Either gives the same rows in the same partitions
    whenever it is read, so that rows can be known by their number: anything
    with an exchange may deal rows anew as soon as other columns are read."""
    steady_scans(df.sparkSession)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" :+-").split(" ")[0] for line in plan.splitlines() if line.strip()]
    plain = sum(n == "Relation" for n in nodes) == 1 and set(nodes) <= {"Relation", "Project", "Filter"}
    return df if plain else staged(df, name)


@contextlib.contextmanager
def staging_scope() -> Iterator[list[str]]:
    """The paths of the tables that this thread stages while it lasts, for
    drop_staged() once the query's result has been read."""
    paths: list[str] = []
    _SCOPES.open = [*getattr(_SCOPES, "open", []), paths]
    try:
        yield paths
    finally:
        _SCOPES.open = [s for s in _SCOPES.open if s is not paths]


def drop_staged(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes the given staged tables; all of this driver process if none
    are given."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(_STAGED if paths is None else paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        with contextlib.suppress(ValueError):
            _STAGED.remove(path)


def drop(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that staged() returned, once nothing
    reads it any more; of any other it does nothing."""
    path = getattr(df, "_staged_at", None)
    if path:
        drop_staged(df.sparkSession, [path])


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what is staged while it lasts, but the staged tables that are
    put into the list."""
    kept: list[DataFrame] = []
    with staging_scope() as paths:
        try:
            yield kept
        finally:
            stay = {df._staged_at for df in kept}
            drop_staged(spark, [p for p in paths if p not in stay])


def together(*calls: Callable, at_once: int | None = None) -> list:
    """What the calls return, made in threads at the same time, in this order
    if not all at once: while one waits for a small step or its last task, the
    others use the cores. What they stage is in the caller's scopes. All end
    before an error of one is raised."""
    scopes = getattr(_SCOPES, "open", [])

    def scoped(call: Callable):
        _SCOPES.open = scopes
        return call()

    with ThreadPoolExecutor(at_once or max(1, len(calls))) as pool:
        asked = [pool.submit(inheritable_thread_target(lambda call=call: scoped(call))) for call in calls]
    return [x.result() for x in asked]


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, by the optimizer's figures for its
    leaves: costs no scan. (Its figure for df itself multiplies the sizes of
    joined tables.) A leaf of unknown size counts as empty."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.length()))
    return sum(x for x in sizes if x < 1 << 60)


def shuffle_width(df: DataFrame, bytes_per_part: int = 16 << 20, ratio: float = 1.0) -> int:
    """How many parts an exchange of df's contents should have: the session's
    setting, or more where the input is so large that parts would outgrow
    bytes_per_part."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(100_000, int(input_bytes(df) * ratio) // bytes_per_part))
