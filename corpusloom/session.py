"""Session helpers: the shared folder and lineage cuts by written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is what ``spark.checkpoint.dir`` of the session names. Where that is unset (tests, one machine), a
    temporary folder is made once per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS or not os.path.isdir(_LOCAL_DIRS[app]):
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="corpusloom-")
    return "file://" + _LOCAL_DIRS[app]


def _work_dir(spark: SparkSession) -> str:
    """The folder of this application's own tables, below the shared one."""
    return f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Delete all tables that operators wrote for this application; results that read them must have been used by then."""
    drop_path(spark, _work_dir(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize`; only for tables nothing reads any more."""
    files = df.inputFiles()
    if files:
        folder = files[0].rsplit("/", 1)[0]
        if "/corpusloom/" in folder:
            drop_path(df.sparkSession, folder)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores, for work that costs far more than moving rows.

    Inputs of that many partitions, which is to say all large ones, stay as they are and aren't shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    sizes = [p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths]
    # as the reader cuts files: at most maxPartitionBytes, and less if the cores would not all be used
    in_bytes = lambda key, usual: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, usual))
    opening = in_bytes("spark.sql.files.openCostInBytes", "4MB")
    largest = min(in_bytes("spark.sql.files.maxPartitionBytes", "128MB"), max(opening, (sum(sizes) + opening * len(sizes)) // cores))
    return df if sum(-(-n // largest) for n in sizes) >= cores else df.repartition(cores)
