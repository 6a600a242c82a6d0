"""Session settings the operators rely on, the shared folder, and how the package gets to executors."""

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Runtime settings only: they hold for a session somebody else started.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A query, host or key may hold a third of all rows: AQE splits such a
    # partition of a join, also where the split costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Sizes are of compressed bytes, and a recorded row takes ten times as many
    # or more once read: smaller parts are sorted in memory, not on disk.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def tuned(spark: SparkSession) -> SparkSession:
    """The session with the library's runtime settings set on it."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", app: str = "rankframe") -> SparkSession:
    """A session for one machine: tests, the bench, a first look."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = tuned(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a session on one machine
    that names none gets a temporary one; a cluster has to name its own, since a
    local folder is lost with its node."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        folder = tempfile.mkdtemp(prefix="rankframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a session that was started without
    it (no ``--py-files``, not installed there)."""
    here = pathlib.Path(__file__).resolve().parent
    # The driver serves the file for as long as the session lasts.
    path = pathlib.Path(tempfile.mkdtemp(prefix="rankframe-")) / "rankframe.zip"
    with zipfile.ZipFile(path, "w") as held:
        for file in sorted(here.rglob("*.py")):
            held.write(file, file.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(path))
