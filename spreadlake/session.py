"""Session settings, and the shared folder for checkpoints and stream state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Folders of single-process sessions without the setting, by application.
_OWN_FOLDERS: dict[str, str] = {}

# Settings the results depend on: timestamps are UTC, a repeated map key keeps
# its last value (size charts may list one system twice).
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Settings that only change speed.
SPEED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # the caps per scan are larger than the default limit up to which a ranking
    # is cut before its shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in {**RESULT_CONF, **SPEED_CONF}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "spreadlake") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**RESULT_CONF, **SPEED_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only where the setting is absent (tests on one machine) is a local folder
    made; a cluster master without the setting is an error rather than a guess.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    # one process, so its own folder is shared; remembered here, as a running
    # session does not take the setting any more
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="spreadlake-")
    return _OWN_FOLDERS[app]


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows to a table in the shared folder, read it back.

    Values that depend on how a shuffle placed the rows (partition ids) stay
    fixed when an executor is lost. Unlike a checkpoint of rows, the table is
    columnar, so later steps read only the columns they use, and its size is
    known, so Spark's choice between broadcast and shuffle rests on a fact.
    """
    path = new_shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, and known to the optimizer to have none: joins with it fold away."""
    fields = StructType.fromDDL(schema).fields
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
