"""Session defaults and scratch storage that survives the loss of executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here is written for."""
    builder = SparkSession.builder.appName("larder")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where the session names none."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    made = "file://" + os.path.join(tempfile.gettempdir(), f"larder-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once per application.

    Nothing is done where the workers find it anyway: on the driver's own machine, by PYTHONPATH or as
    the working directory. Elsewhere the package goes along as an archive in the shared folder.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    root, master = package.parent, context.master
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if master.startswith("local") and (root in known or (not master.startswith("local-cluster") and Path.cwd() == root)):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(root))
    place = f"{shared_dir(spark).rstrip('/')}/larder-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(place)


def stored(folder: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """A table of the shared folder in batches of up to ``rows``, read by a task; a batch is a run of one file."""
    files, place = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith(("/", "file:")) else fs.FileSystem.from_uri(folder)
    for f in sorted(f.path for f in files.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet")):
        with files.open_input_file(f) as source:
            yield from pq.ParquetFile(source).iter_batches(rows, columns=columns)


class Scratch:
    """Tables written to the shared folder to cut lineage between the rounds of an iteration.

    A written table is columnar, compressed and replicated by the file system, so a lost executor
    costs the tasks it ran and nothing else. ``drop`` removes the tables of earlier rounds.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, codec: str = "zstd", by: str | None = None) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(path, partitionBy=by)
        # The schema is passed on: no job to infer it, and an empty table stays readable.
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = self.paths.pop(id(table), None)
            if path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
