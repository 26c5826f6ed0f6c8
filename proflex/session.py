"""Spark session helpers.

The library never creates its own cluster settings for production use: jobs read
`spark.checkpoint.dir` from the running session (a shared folder on a cluster) and
only fall back to a scratch folder when it is unset, which is the local test case.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every local run (tests, bench, entry) uses.  On a cluster these come from
# the submit configuration; AQE does the runtime re-planning (coalescing, skew-join
# splitting, broadcast conversion from measured sizes).
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    # remove checkpoint files once nothing references them (they live in the shared folder)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Runtime SQL settings the operators rely on for speed; `tune_session` applies them to a
# session someone else created (they are session-scoped, not cluster-wide).
RUNTIME_CONF = {
    # JVM case mapping for lower()/upper(): the ICU path builds a break iterator per call
    # and dominates tokenisation time; results are equal on Latin and Cyrillic text.
    "spark.sql.icu.caseMappings.enabled": "false",
}


def tune_session(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make `proflex` importable in Python workers (pandas UDFs, mapInPandas) wherever the
    job was started: the package is zipped once per SparkContext and added with addPyFile,
    which distributes it to every executor."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="proflex-pyfiles-"), "proflex.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def build_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "proflex") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("proflex.input.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tune_session(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session, setting one only if unset."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not current:
        current = sc.getCheckpointDir() if sc.getCheckpointDir() else None
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        current = tempfile.mkdtemp(prefix="proflex-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"
