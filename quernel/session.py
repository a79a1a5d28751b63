"""Session settings and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch that goes to Python, unless the session says otherwise: long texts must not pile up.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(app: str = "quernel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; on a cluster, pass none and configure there."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.  Where that is unset, a temporary
    folder in local mode, as in tests; on a cluster an error, since other machines would not see it."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quernel-")
        root = _OWN[context.applicationId]
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, as spark-submit --py-files would; and bound the bytes of an Arrow
    batch (BATCH_BYTES) in every session that has no bound of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quernel-ship-")
    target = os.path.join(folder, "quernel.zip")
    with zipfile.ZipFile(target, "w") as out:
        for top, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    out.write(path, os.path.join("quernel", os.path.relpath(path, root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
