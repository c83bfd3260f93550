"""Session settings and the shared folder for checkpoints and stream state."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot join keys even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# only when a session starts: no look-up of the calling line for every column, so plans build faster
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on; sizes of partitions stay with the cluster's own settings."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "*", app: str = "quern", **conf: str) -> SparkSession:
    """A small local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**RUNTIME_CONF, **START_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, or below the warehouse where that is unset.

    Driver and executors share both. What is written there goes when the
    application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/quern"
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    return path


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_bytes(spark: SparkSession, path: str, block: bytes) -> None:
    """Write one file through Spark's own file systems; it goes when the application ends."""
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    out = system.create(target)
    try:
        for at in range(0, len(block), 1 << 20):
            out.write(bytearray(block[at : at + (1 << 20)]))
    finally:
        out.close()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application; their Python workers import it by name."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.writestr(str(source.relative_to(root.parent)), source.read_bytes())
    target = f"{shared_dir(spark, 'package')}.zip"
    write_bytes(spark, target, packed.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(application)
