"""Session set-up for tests, benchmarks and single-machine use."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A UTC session on ``local[cpus]``; an existing session is returned as it is."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tarnfall")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session.

    They may have another working directory than the driver, or no copy of the package.
    Spark's own file server hands it out from the driver.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    handle, path = tempfile.mkstemp(prefix="tarnfall-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
