"""Session construction and the shared work folder."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "vellumdex", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    spark = builder.config(map=settings).getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where a local session leaves that setting empty is a folder made here; on a
    cluster the setting must be there, since a machine's own folder would not do.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="vellumdex-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def materialize(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> str:
    """Writes ``df`` once as compressed Parquet in the shared folder; the new folder, which goes with the shared one."""
    folder = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as compressed Parquet in the shared folder and read back.

    Where many rows are used several times, this is smaller on disk than a checkpoint and
    lets each reader prune columns and rows.
    """
    folder = stored(df)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def publish_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """Writes ``data`` once to the shared folder and registers it with Spark's file server.

    Workers find it as ``SparkFiles.get(name)``; an executor that joins later fetches it
    again. ``name`` must change with the content.
    """
    context = spark.sparkContext
    jvm = context._jvm
    target = f"{shared_dir(spark)}/files/{name}"
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(path):
        part = jvm.org.apache.hadoop.fs.Path(f"{target}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        if not fs.rename(part, path):
            fs.delete(part, False)
    context.addFile(target)
    return name


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to all Python workers, wherever they run and whatever their path is."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if not name.endswith(".pyc"):
                    path = os.path.join(folder, name)
                    archive.writestr(zipfile.ZipInfo(os.path.join(os.path.basename(root), os.path.relpath(path, root))), open(path, "rb").read())
    data = buffer.getvalue()
    name = f"vellumdex-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    publish_bytes(spark, data, name)
    context.addPyFile(f"{shared_dir(spark)}/files/{name}")
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
