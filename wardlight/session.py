"""Session set-up and the size checks every broadcast or collect goes through."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import wardlight

# Rows a side may hold before it is shuffled instead of broadcast. Callers pass
# narrow tables (a few doubles per row), so this stays far below Spark's 8 GB cap.
BROADCAST_ROWS = 200_000
# Whole texts in one Arrow batch.
TEXT_ROWS = 1_000


def build_session(app: str = "wardlight", cpus: int | str = "*", memory: str = "12g") -> SparkSession:
    """Local session for tests and bench.py; a cluster brings its own."""
    shuffle = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Generated methods above 8 kB are not compiled by the JVM; let wide rule
        # expressions fall back to split projections instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package()
    return spark


def ship_package() -> None:
    """Let Spark send this package's functions to the Python workers by value.

    Not needed where the package is installed on the workers or named in
    ``--py-files``; the state driver process of streaming queries gets no
    archives, so shipping by value is the way that always works.
    """
    cloudpickle.register_pickle_by_value(wardlight)


def setting(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    return value if value else spark.sparkContext.getConf().get(key, None)


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Hand whole texts to Python in small Arrow batches.

    Each running task holds a batch on both sides and Arrow's buffers double as they grow, so ten thousand
    texts (Spark's default) take hundreds of megabytes of an executor outside its heap.
    """
    if int(setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch") or 10_000) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def compiled_methods(spark: SparkSession, size: int = 8_000) -> None:
    """Let Spark give up fused code whose methods the JVM would only interpret.

    The JVM never compiles a method above 8,000 bytes; Spark fuses steps into methods of up to 65,535 by default.
    Above the limit a step runs as projections of its own, which Spark splits into small methods.
    """
    if int(setting(spark, "spark.sql.codegen.hugeMethodLimit") or 65_535) > size:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, named in ``spark.checkpoint.dir``."""
    path = setting(spark, "spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="wardlight-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the data survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; stops counting soon after."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row check; beyond it the join shuffles (AQE splits skew)."""
    return F.broadcast(df) if fits(df, rows) else df


def collect_bounded(df: DataFrame, rows: int) -> list:
    """Collect a table whose size the caller can bound; raise rather than truncate."""
    out = df.limit(rows + 1).collect()
    if len(out) > rows:
        raise ValueError(f"expected at most {rows} rows on the driver")
    return out


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer splits than cores (one big unsplittable file).

    At scale scans have far more splits than cores and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
