"""Helpers shared by the operators: shared storage, table access, column hygiene."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a local session) a local folder
    is made, once per session, and set as the checkpoint folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="chronomotif-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage at a place that outlives any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[id(out)] = path
    weakref.finalize(out, _stored.pop, id(out), None)
    return out


#: Where tables of :func:`materialize` lie, as long as their frames are held.
_stored: dict[int, str] = {}


def release(*frames: DataFrame) -> None:
    """Remove the tables of :func:`materialize` that these frames read, once nothing reads them any more."""
    for df in frames:
        path = _stored.pop(id(df), None)
        if path:
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: A key is heavy that more than this share of all rows have, of so many rows at least: heavy keys are fewer than one by the share.
HEAVY_SHARE, HEAVY_ROWS = 1 / 1024, 1000


def heavy_keys(counts: DataFrame, key: str, n: str) -> DataFrame | None:
    """Of a table with a row and its count for each key, the heavy keys, few enough to broadcast; None where none is."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    heavy = counts.filter(F.col(n) > max(HEAVY_ROWS, int(total * HEAVY_SHARE))).select(key)
    return F.broadcast(heavy) if heavy.limit(1).count() else None


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: functions of arrays are evaluated anew wherever they stand in another's body."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements that :func:`scan` holds in one piece; pieces are joined at the end, so that a long array isn't copied for each element.
SCAN_PIECE = 256


def scan(items: Column, state: Column, step, out: str) -> Column:
    """A running fold: for each of ``items`` in turn, ``step(state, item)`` gives a struct of the next ``state`` and what to put ``out``.

    ``out`` is the type of that, as text. The result is the array of what was put out.
    """
    none, pieces = (F.array().cast(f"array<{'array<' * k}{out}{'>' * k}>") for k in (0, 1))

    def one(a: Column, x: Column) -> Column:
        return bound(step(a["s"], x), lambda t: F.struct(t["state"].alias("s"), F.concat(a["out"], F.array(t["out"])).alias("out")))

    def piece(a: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(items, k * SCAN_PIECE + 1, F.lit(SCAN_PIECE)), F.struct(a["s"].alias("s"), none.alias("out")), one)
        return bound(inner, lambda t: F.struct(t["s"].alias("s"), F.concat(a["out"], F.array(t["out"])).alias("out")))

    n = F.size(items)
    whole = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / SCAN_PIECE).cast("int")), F.struct(state.alias("s"), pieces.alias("out")), piece, lambda a: F.flatten(a["out"]))
    return F.when(n > 0, whole).otherwise(none)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``CHRONOMOTIF_TOKENIZERS`` names another folder."""
    folder = os.environ.get("CHRONOMOTIF_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession, path: str) -> None:
    """Send a file to every worker; it is found there by :func:`shipped`."""
    spark.sparkContext.addFile(path)


def shipped(path: str) -> str:
    """In a worker: the file's own place where the worker has it too, else the copy that was sent."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package comes with ``--py-files`` or the image; then this
    path just isn't there.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, *known) if x)
