"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "ledgerlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return a session tuned for this workload.

    AQE stays on so small shuffles coalesce and hot refs / hot amounts are
    split by the skew-join rule; the UI is off (no server is started).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is used as is.  Only
    when it is unset (local tests) is a fresh scratch folder created and
    registered, so lineage cuts never land on a machine-local path in
    production.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Lineage cut: ``df`` computed once and written as Parquet under the
    shared checkpoint folder (never local), then read back.  Unlike an eager
    ``checkpoint()`` of an unpersisted plan, the rows are computed once."""
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def checked_broadcast(small: DataFrame, name: str = "per-key") -> DataFrame:
    """A per-sheet / per-file / per-group table made safe to join to
    data-sized rows.

    The table (an aggregate over the data) is computed once and written as
    Parquet to the shared checkpoint folder, then read back: a lineage cut,
    and its real file size becomes the relation's size statistic, so the
    planner broadcasts it - the data side streams through the join without
    a shuffle - only while that size is under
    ``spark.sql.autoBroadcastJoinThreshold``; above it the join shuffles
    both sides (AQE still splits skew)."""
    import uuid

    spark = small.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    small.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    path = os.path.join(checkpoint_dir(spark), name)
    spark.sparkContext.__dict__.setdefault("_ledgerlens_scratch", []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session, on whatever file
    system they lie.  Results that still read them must be written first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in spark.sparkContext.__dict__.pop("_ledgerlens_scratch", []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package's functions to Python workers by value, whatever
    file system the cluster shares."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules["ledgerlens"])


def stage(df: DataFrame, name: str, order_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: a lineage cut that survives executor loss, and a columnar copy
    that later passes scan with pruning and predicate pushdown.

    With ``order_by`` the rows are range-partitioned and sorted on those
    columns first: a large group spreads over several files, and range
    predicates on the sort columns skip row groups."""
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    if order_by:
        n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        df = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    else:
        # an input with fewer splits than task slots (one small file) is
        # spread round-robin so that every later pass runs in parallel; a
        # large input already has more splits and is written as it is
        slots = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < slots:
            df = df.repartition(slots)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Files a task of ``stage_by`` writes side by side.
WRITERS = 4


def stage_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """``stage`` with one folder per value of a low-cardinality ``column``:
    a filter on it reads that folder alone.  A task keeps the files of up to
    ``WRITERS`` values open, so that its rows need no sort by ``column``; those
    of further values are sorted."""
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    slots = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        df = df.repartition(slots)
    schema = df.schema
    conf = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(conf, None)
    try:
        spark.conf.set(conf, str(WRITERS))
        df.write.mode("overwrite").partitionBy(column).parquet(path)
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
    return spark.read.schema(schema).parquet(path)
