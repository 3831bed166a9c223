"""Session helpers: a local session for tests and bench, and shipping this package to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Gives executors this package as a zip, once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="emberfield-code-")) / "emberfield.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"emberfield/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(where))
    _shipped.add(app)


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", name: str = "emberfield") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new temporary folder in local
    mode; on a cluster an error, as executors don't see the driver's temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        where = "file://" + tempfile.mkdtemp(prefix="emberfield-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the tables that materialize() wrote for these frames. Only for tables that nothing lazy still reads."""
    for df in frames:
        if path := vars(df).pop("stored_at", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
