"""Session helpers: building a local session for tests/bench, and lineage cuts.

Lineage is cut by writing a narrow table to the shared folder named by
``spark.checkpoint.dir`` (read from the session).  Only when that setting is
absent (local tests) do we pick a scratch folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "ticketsift") -> SparkSession:
    """A local session configured like the tests and bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only if unset."""
    conf_dir = spark.conf.get(_CKPT_KEY, None) or spark.sparkContext.getConf().get(_CKPT_KEY, None)
    if not conf_dir:
        # a machine-local folder is only valid when driver and executors
        # share one machine; on a cluster the shared folder must be named
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CKPT_KEY} to a folder shared by all executors")
        conf_dir = tempfile.mkdtemp(prefix="ticketsift-ckpt-")
        spark.conf.set(_CKPT_KEY, conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


_SCOPE_KEY = "ticketsift.scratch.scope"
#: Row groups of intermediate tables.
ROW_GROUP_BYTES = 16 << 20


@contextmanager
def scratch_scope(spark: SparkSession, name: str) -> Iterator[str]:
    """Every table ``materialize`` writes inside the block goes to one folder
    (yielded), so the intermediate tables of one run can be dropped together
    once its results are exported.  Nothing is deleted here."""
    prev = spark.conf.get(_SCOPE_KEY, None)
    folder = os.path.join(ensure_checkpoint_dir(spark), "ticketsift", f"{name}-{uuid.uuid4().hex}")
    spark.conf.set(_SCOPE_KEY, folder)
    try:
        yield folder
    finally:
        if prev:
            spark.conf.set(_SCOPE_KEY, prev)
        else:
            spark.conf.unset(_SCOPE_KEY)


def materialize(df: DataFrame, name: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Used for narrow intermediate tables (labels, counts) that are read more
    than once, so the expensive upstream (tokenising whole texts) runs once and
    a lost executor re-reads files instead of recomputing the lineage.
    With ``partition_by`` the table is written in one folder per value, so a
    later filter on that column reads only the matching folders.
    """
    spark = df.sparkSession
    base = spark.conf.get(_SCOPE_KEY, None) or os.path.join(ensure_checkpoint_dir(spark), "ticketsift")
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex}")
    # a writer holds a row group on the heap; small ones keep many wide tables apart
    w = df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
