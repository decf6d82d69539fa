"""Session helpers: local sessions for tests/bench, and shared scratch space.

Library code never sets cluster configuration.  The only thing it needs is a
reliable checkpoint folder; it is read from ``spark.checkpoint.dir``.  A
machine-local temporary folder is used only when that setting is missing
*and* the master is local (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _driver_memory() -> str:
    """About 60% of physical memory, at most 16 GiB (local mode: the driver is the executor)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(total * 0.6 / 2 ** 30)))}g"


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "plotrows") -> SparkSession:
    """A local session configured like the tests and the bench."""
    parts = shuffle_partitions or (cores if isinstance(cores, int) else 8)
    ckpt = tempfile.mkdtemp(prefix="plotrows-ckpt-")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", _driver_memory())
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", ckpt)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, wiring it from the session conf.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder (HDFS, S3,
    ...); it is an error to leave it unset there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "so lineage cuts survive executor loss")
        conf = tempfile.mkdtemp(prefix="plotrows-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for derived tables."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root.rstrip("/"), "plotrows-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder and cut its lineage.

    Used after range partitioning, whose sampled boundaries must not change if
    a lost executor forces a recompute.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``plotrows`` importable by every Python worker, once per application.

    Functions handed to ``mapInPandas``/pandas UDFs are pickled by reference to
    this package, so workers must be able to import it.  On a cluster this is
    normally done with ``--py-files``; this zips the installed package from the
    driver and registers it with ``addPyFile`` if that has not happened yet.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="plotrows-pkg-")
    base = os.path.join(staging, "plotrows")
    shutil.make_archive(base, "zip", root_dir=os.path.dirname(pkg_dir), base_dir="plotrows")
    sc.addPyFile(base + ".zip")
    _SHIPPED.add(app)
