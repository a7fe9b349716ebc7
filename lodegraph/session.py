"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodegraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local master may do with a folder of its machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lodegraph-checkpoint-")
        atexit.register(shutil.rmtree, shared, True)
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package: where they can't, it is sent to them as a zip, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = __name__.partition(".")[0]

    def probe(batches):
        import importlib.util

        for pdf in batches:
            pdf["ok"] = importlib.util.find_spec(package) is not None
            yield pdf[["ok"]]

    if not spark.range(1, numPartitions=1).mapInPandas(probe, "ok boolean").first()["ok"]:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix=f"{package}-")  # the driver's own copy; executors fetch it from the driver
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, f"{package}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(os.path.join(root, package)):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), root))
        spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
