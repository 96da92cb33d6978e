"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; everything else is left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Texts are long: small Arrow batches keep the buffers of executors and Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators assume and give executors this package."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the Python workers, once per application.

    Functions that run there are found by module name, and workers need not share the
    driver's folder or search path.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _shipped or not os.path.isdir(package):
        return
    folder = tempfile.mkdtemp(prefix="pressline-code-")  # the driver serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "pressline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for place, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def local_session(cores: str = "8", app: str = "pressline") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder, which goes when the program ends: executors on other
    machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _scratch:
        _scratch[application] = tempfile.mkdtemp(prefix="pressline-")
        atexit.register(shutil.rmtree, _scratch[application], ignore_errors=True)
    return _scratch[application]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that iterations do not replay earlier ones."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
