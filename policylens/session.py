"""Session for tests, the bench and local runs; on a cluster the caller brings its own."""

import tempfile

from pyspark.sql import SparkSession


def local_session(cores=8, app="policylens", memory="12g", shared=None):
    """`shared` is the folder for intermediate tables; a new temporary one unless it is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix=f"{app}-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
