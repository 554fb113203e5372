"""Session helpers: a local session for tests and benches, and the shared
checkpoint folder.

On a cluster the checkpoint folder is whatever the cluster names in
``spark.checkpoint.dir``; it is only filled in here when it is unset, which
is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    # Generated methods longer than this are not fused into one whole-stage
    # method; Spark then splits the expressions into small methods. The JVM
    # JIT does not compile methods over 8,000 bytecodes, so the unrolled
    # distance expressions over many centres would otherwise run in the
    # bytecode interpreter (about 8x slower, measured on lineitem).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "vicinity") -> SparkSession:
    """A ``local[cores]`` session with AQE on and the UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def allow_group_limit(spark: SparkSession, places: int) -> None:
    """Let Catalyst cut groups to ``places`` rows before the shuffle, however many they are.

    Above this conf (1,000 by default) a top-k sends every row of a group to
    one task.
    """
    if places >= int(spark.conf.get(GROUP_LIMIT_CONF, "1000")):
        spark.conf.set(GROUP_LIMIT_CONF, str(places + 1))


@contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside the block; the caller's are put back after it."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="vicinity-core-"), "vicinity_core.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder of this session, or ``None``."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    return conf or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a fresh local one only if unset.

    A cluster sets ``spark.checkpoint.dir`` to a shared folder; a machine-local
    fallback is made only for local sessions (tests, benches).
    """
    current = checkpoint_dir(spark)
    if current:
        sc = spark.sparkContext
        if not (hasattr(sc, "getCheckpointDir") and sc.getCheckpointDir()):
            sc.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="vicinity-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{os.urandom(6).hex()}"


#: What a write has shuffled goes with it: the written table is what is read again.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def materialize(df, name: str = "table", compression: str = "snappy"):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but computes the plan once (an
    un-cached ``checkpoint()`` computes it twice) and stores a columnar,
    compressed table that any executor can re-read after a loss. The shuffle files
    of the write are dropped at its end; they would stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with session_conf(spark, DROP_SHUFFLES):
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.parquet(path)
