"""Session construction and the few engine-wide physical helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

#: A side may be broadcast when it is shown to hold no more rows and bytes than this.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20

_own_folder: str | None = None


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName("rotativa")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that ``spark.checkpoint.dir`` names, where every machine can read it.

    Without that setting a session on one machine gets a folder of its own, removed at the end of the process;
    on a cluster the call fails, since what one machine writes to its own disk cannot be read by the others.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="rotativa-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and cut its lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _bytes_of(field: StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) if isinstance(field.dataType, (ArrayType, MapType, StructType)) else F.lit(8)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after checking that ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes.

    The side is materialised first (unless it already is), so that it is computed once for the check and the
    join. A larger side comes back without the hint, and the join falls to a shuffled plan chosen by Catalyst and AQE.
    """
    side = df if "LogicalRDD" in df._jdf.queryExecution().analyzed().getClass().getSimpleName() else cut(df)
    size = sum((_bytes_of(f) for f in df.schema.fields), F.lit(0))
    rows, held = side.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(side) if rows <= max_rows and (held or 0) <= max_bytes else side
