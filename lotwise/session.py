"""Session helpers: settings that the operators rely on, and scratch storage."""
import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lotwise", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every query needs: UTC, adaptive plans, skew handling, measured broadcasts, ordered maps."""
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
        ("spark.sql.adaptive.coalescePartitions.enabled", "true"),
        # small but CPU-heavy stages keep their parallelism
        ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k"),
        ("spark.sql.mapKeyDedupPolicy", "LAST_WIN"),
        # sizes of files say little of rows with derived texts or repeated values: what is broadcast is measured first
        ("spark.sql.autoBroadcastJoinThreshold", "256k"),
        ("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m"),
    ):
        spark.conf.set(key, value)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package (code only), once per application; for functions that call others of it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "lotwise_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


_HOMES: dict[str, str] = {}


def require_shared(root: str, master: str, default_fs: str) -> None:
    """Raises where a folder is on the driver's own disk but tasks run elsewhere."""
    scheme = root.split(":", 1)[0] if ":/" in root else default_fs.split(":", 1)[0]
    if scheme == "file" and not master.startswith("local"):
        raise ValueError(f"{root} is a local folder of the driver: set spark.checkpoint.dir to storage that all executors share")


def checkpoint_root(spark: SparkSession) -> str:
    """This application's folder for checkpoints and written tables, on storage that all executors share.

    It lies below ``spark.checkpoint.dir``; where none is named, below
    ``spark.sql.warehouse.dir``.  On a cluster that must not be a folder of the driver's
    machine, where executors would not find it: that is an error.  The session's settings
    are left as they are.  The folder goes when the application ends, or by ``sweep``.
    """
    app = spark.sparkContext.applicationId
    if app not in _HOMES:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
            require_shared(root, spark.sparkContext.master, spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///"))
        _HOMES[app] = f"{root.rstrip('/')}/lotwise-{app}"
        atexit.register(_end, spark, app)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_HOMES[app] + "/checkpoints")
    return _HOMES[app]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, on whatever file system it is; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in files.listStatus(where)] if files.exists(where) else []


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application has staged; call it when the results that read it are written."""
    app = spark.sparkContext.applicationId
    if app in _HOMES:
        remove(spark, _HOMES[app])
        for slot in [slot for slot in _STORED if slot[0] == app]:
            del _STORED[slot]


def _end(spark: SparkSession, app: str) -> None:
    """At exit: nothing to do where the application has been stopped before."""
    context = spark.sparkContext
    if context._jsc is not None and context.applicationId == app:
        sweep(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


_STORED: dict = {}


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back; what its plan shuffled is deleted at once, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate result as a table in the shared folder and reads it back.

    Used where a plan needs the same result more than once: it is computed once,
    its size is then known to the planner, its lineage is cut, and losing an
    executor does not lose it.
    """
    return written(df, scratch(df.sparkSession, name))


def stamps(spark: SparkSession, source: DataFrame) -> tuple:
    """Path, length and modification time of every file that a table is read from."""
    jvm, found = spark.sparkContext._jvm, []
    for name in sorted(source.inputFiles()):
        where = jvm.org.apache.hadoop.fs.Path(name)
        status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)


def stored(spark: SparkSession, key: str, build, sources: DataFrame | list[DataFrame] | tuple = ()) -> DataFrame:
    """A derived base table, written once per application and read by every later query.

    ``sources``: the tables that it is built from, or the only one; when one of their files changes, it is derived anew.
    """
    if isinstance(sources, DataFrame):
        sources = [sources]
    slot = (spark.sparkContext.applicationId, key, tuple(stamps(spark, source) for source in sources))
    if slot not in _STORED:
        df = build()
        path = scratch(spark, key.strip("/").replace("/", "_").replace(":", "_"))
        written(df, path)
        _STORED[slot] = (path, df.schema)
    path, schema = _STORED[slot]
    return spark.read.schema(schema).parquet(path)
