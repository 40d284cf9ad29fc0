"""Stage tables: cut a lineage by writing it once to the folder the cluster names."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans are written for; a value the caller has set stays.
SETTINGS = {
    # the JVM interprets methods above 8000 bytes: let Spark split such a stage instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}

_LOCAL: dict[str, str] = {}
_NOTED: list[list[str]] = []
_SHARED: dict[tuple[str, str, str, tuple], DataFrame] = {}
_WRITTEN: dict[str, list[str]] = {}


def tune(spark: SparkSession) -> SparkSession:
    given = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in SETTINGS.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


def stage_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. On a local master that names none, as in tests, a folder
    of this process, removed at its end; a cluster must name one that every executor can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="crosstide-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Operators that read their input several times (group statistics joined back, iterative fits)
    start from a staged table, so an expensive upstream runs once. The files outlive lost
    executors, prune columns, and carry the sizes Spark needs to choose a join.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/stage-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    _WRITTEN.setdefault(spark.conf.get("spark.app.id", "local"), []).append(path)
    for paths in _NOTED:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of a query that ends meanwhile: once its result is written nothing reads them again, and waiting
    for the driver to collect garbage would pile up the shuffles of all steps."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def small_broadcasts(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run meanwhile broadcasts a table of at most ``most`` bytes; a smaller limit of the caller stays.

    Spark compares its limit with the files of a table. Ids pack well: as a hash table on the driver the same rows take twenty
    times as much and more, and an operator that joins many such tables fills the driver with them.
    """
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in before.items():
        if value and _bytes(value) > most:
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            if value:
                spark.conf.set(key, value)


def _bytes(size: str) -> int:
    """A size as Spark's settings give it."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """The paths that ``stage`` writes meanwhile."""
    paths: list[str] = []
    _NOTED.append(paths)
    try:
        yield paths
    finally:
        _NOTED[:] = [p for p in _NOTED if p is not paths]


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        at, files = _filesystem(spark, path)
        files.delete(at, True)
    written = _WRITTEN.get(spark.conf.get("spark.app.id", "local"), [])
    written[:] = [p for p in written if p not in set(paths)]


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has staged; results that read them have to be written before."""
    app = spark.conf.get("spark.app.id", "local")
    remove(spark, list(_WRITTEN.get(app, [])))
    for key in [k for k in _SHARED if k[0] == app]:
        del _SHARED[key]


def _state(spark: SparkSession, folder: str) -> tuple:
    """Size and number of a folder's files and the times of its entries: changes when a table is written anew."""
    at, files = _filesystem(spark, folder)
    if not files.exists(at):
        return ()
    summary = files.getContentSummary(at)
    return summary.getLength(), summary.getFileCount(), tuple(sorted((e.getPath().getName(), e.getModificationTime()) for e in files.listStatus(at)))


def shared(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], *, write: bool = True) -> DataFrame:
    """The table ``name`` that is derived from the folder ``source``, staged once per session and state of the folder.

    Queries of a family start from one written table instead of writing it each. Once the folder's files change it is
    built anew. Without ``write`` a table that is not there yet is derived only: for a query that reads its rows once.
    """
    key = (spark.conf.get("spark.app.id", "local"), name, source, _state(spark, source))
    if key not in _SHARED and not write:
        return build()
    if key not in _SHARED:
        _SHARED[key] = stage(build())
    return _SHARED[key]
