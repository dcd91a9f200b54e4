"""Session defaults and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Folders of staged tables by application.
_STAGED: dict[str, list[str]] = {}


def build_session(app: str = "rarespark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library is tuned for. Every setting can be overridden."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Very wide score projections run as separate compilable methods, not as one huge one.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Text files in any code page that Java knows.
        "spark.sql.legacy.javaCharsets": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables; a local one is made only in local mode, if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        shared = tempfile.mkdtemp(prefix="rarespark-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}/{name}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder on whatever file system holds it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from that table.

    Used where several later jobs read the same derived table, so that they all see one snapshot, read
    only the columns they need, and a lost executor costs a re-read instead of a recomputation.
    ``unstage`` removes a table that is no longer needed, ``release`` all tables staged in the session.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return _staged(df, path)


def stage_until(df: DataFrame, deadline: float) -> DataFrame | None:
    """``stage``, given up at ``deadline`` (by the monotonic clock): its jobs are cancelled and what they wrote is removed."""
    spark = df.sparkSession
    sc, tag, path = spark.sparkContext, f"stage-{uuid.uuid4().hex}", scratch_path(spark, "table")
    left, late = deadline - time.monotonic(), threading.Event()
    if left <= 0:
        return None

    def cancel() -> None:
        late.set()
        while not over.wait(0.2):  # a write is more than one job
            sc.cancelJobsWithTag(tag)

    over, timer = threading.Event(), threading.Timer(left, cancel)
    timer.daemon = True
    sc.addJobTag(tag)
    timer.start()
    try:
        df.write.parquet(path)
    except Exception:
        if not late.is_set():
            raise
        delete_path(spark, path.rsplit("/", 1)[0])
        return None
    finally:
        over.set()
        timer.cancel()
        sc.removeJobTag(tag)
    return _staged(df, path)


def _staged(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    table = spark.read.schema(df.schema).parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    table.__dict__["_staged_path"] = path
    return table


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables; nothing may read them afterwards."""
    for df in tables:
        path = df.__dict__.pop("_staged_path", None)
        if path:
            delete_path(df.sparkSession, path.rsplit("/", 1)[0])
            _STAGED.get(df.sparkSession.sparkContext.applicationId, []).remove(path)


def release(spark: SparkSession) -> None:
    """Delete every table staged in this session; results that still read them must be stored first."""
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        delete_path(spark, path.rsplit("/", 1)[0])


#: Plan nodes that keep every file row a row of its own.
_ROW_BY_ROW = {"Project", "Filter", "LogicalRelation"}
#: Bits of an id that count the rows of a file.
_ROW_BITS = 40
#: Bytes of file names that may be broadcast.
_NAMES_BYTES = 64 << 20


def _reads_rows_of_files(df: DataFrame) -> bool:
    """Whether every row stands for one row of a file whose place Spark knows, in each job alike."""
    node = df._jdf.queryExecution().analyzed()
    while True:
        if node.nodeName() not in _ROW_BY_ROW or not node.deterministic():
            return False
        if node.children().isEmpty():
            break
        node = node.children().head()
    try:
        return df.select("_metadata.file_path", "_metadata.row_index") is not None
    except AnalysisException:  # not a format that numbers its rows, or a column of that name hides the place
        return False


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Give every row an id that stays the same however often the result is read.

    Rows of Parquet files are numbered by file and place in it, without a copy, and alike in each session; other tables are stored with their ids.
    """
    if name in df.columns:
        raise ValueError(f"the input already has a column called {name!r}")
    if _reads_rows_of_files(df):
        file = "__file"
        while any(c.startswith(file) for c in df.columns):
            file += "_"
        files = stage(df.select(F.col("_metadata.file_path").alias(file)).distinct())
        found = files.agg(F.count("*").alias("n"), F.sum(F.octet_length(file) + 8).alias("bytes")).first()
        place = F.col("_metadata.row_index").cast("bigint")
        if found["n"] <= 1:
            return df.select(place.alias(name), "*")
        if found["bytes"] <= _NAMES_BYTES:
            number = stage(files.withColumn(f"{file}no", F.row_number().over(Window.orderBy(file)).cast("bigint") - 1))
            placed = df.select(F.col("_metadata.file_path").alias(file), place.alias(f"{file}row"), "*").join(F.broadcast(number), file)
            return placed.select((F.shiftleft(f"{file}no", _ROW_BITS) + F.col(f"{file}row")).alias(name),
                                 *[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
    return stage(df.select(F.monotonically_increasing_id().alias(name), "*"))
