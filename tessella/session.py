"""Session defaults and the two settings every operator relies on."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.javaCharsets": "true",  # reads GBK where UTF-8 fails
    "spark.sql.python.filterPushdown.enabled": "true",  # the corpus source leaves out files by name
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
"""Settings the queries rely on. The operators only read them."""


def prepare(spark: SparkSession) -> SparkSession:
    """Gives a session these settings; for whoever runs the registered queries."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "tessella", shuffle: int = 8,
                  memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle))
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false"))
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a scratch one only if unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
            "spark.checkpoint.dir")
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="tessella-ckpt-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


TIDY_SECONDS, HANDLE_SECONDS = 2.0, 1.2
_tidied = 0.0


def tidy(spark: SparkSession, wait: bool = False) -> None:
    """Lets Spark's cleaner delete shuffle files, broadcasts and checkpoints of frames that
    nobody holds any more. It learns of them when the driver's JVM collects garbage, which a
    job of many short rounds may not give rise to for long. Python's handles of these frames lie
    in cycles, and a worker of py4j lets them go a second later; wait: for what goes just now."""
    global _tidied
    if wait or time.monotonic() - _tidied >= TIDY_SECONDS:
        gc.collect()
        if wait:
            time.sleep(HANDLE_SECONDS)
        spark.sparkContext._jvm.System.gc()
        _tidied = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Materialise and drop lineage on shared storage (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return out
