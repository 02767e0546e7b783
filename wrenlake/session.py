"""Session defaults, table reading and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wrenlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def guard(spark: SparkSession) -> None:
    """Switch off that a union keeps its inputs' partitioning.

    In Spark 4.1.2 a window or aggregate after such a union can see parts of its groups only (lens_evidence gave wrong
    rows, with and without adaptive execution). A session that sets nothing has it on, but conf.get() with a default would give that default.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table, with zone-less timestamps read as UTC instants.

    The files hold microseconds in UTC, some of them without the zone mark; watermarks and
    comparisons of instants need the type with the zone.
    """
    guard(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session may leave it unset and gets a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if not known:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wrenlake-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


#: shuffle files of a write go when it is over, not when the driver happens to collect its garbage
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str = "table", by: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Cuts the lineage as a checkpoint does, but computes the rows once; a lost executor costs nothing,
    as the table doesn't live on it. by: a column by which the rows are already hash-partitioned; the table is then
    bucketed by it, and joins on it don't shuffle the table again.
    """
    spark = df.sparkSession
    guard(spark)
    name = f"wrenlake_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{label}-{name[9:]}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        if by is None:
            df.write.parquet(path)
            out = spark.read.schema(df.schema).parquet(path)
        else:
            df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(name)
            out = spark.table(name)
            out._wrenlake_table = name
    finally:
        spark.conf.set(_CLEANUP, before)
    out._wrenlake_path = path  # for drop()
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that cut() wrote, once nothing reads them any more."""
    for df in tables:
        name, path = getattr(df, "_wrenlake_table", None), getattr(df, "_wrenlake_path", None)
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            sc = df.sparkSession.sparkContext
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
