"""Session helpers shared by all operators: shared checkpoints, size-checked
broadcasts and the session defaults used by tests and benchmarks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is only ever broadcast after it was counted and found at most this long.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors once per context, so that
    kernels can be unpickled there whatever their Python path is."""
    sc = spark.sparkContext
    if getattr(sc, "_kinelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="kinelake-code-"), "kinelake_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)
    sc._kinelake_shipped = True


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package available on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where it is unset
    (tests, one machine) a temporary folder is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if not where and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster has to name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="kinelake-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage:
    the files survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a fact table with a per-key statistics table.

    ``small`` has one row per key and must already be materialised (``cut``).
    It is counted: up to ``limit`` rows it is broadcast, beyond that both
    sides are shuffled on (key, salt) with the statistics repeated per salt,
    so that one hot key is spread over several tasks.
    """
    if small.count() <= limit:
        return big.join(F.broadcast(small), key, how)
    salts = 16
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in big.columns if c != key][:4]), F.lit(salts)).cast("int"))
    return salted.join(spread, [key, "__salt"], how).drop("__salt")


def spread(df: DataFrame) -> DataFrame:
    """Give an input of few file splits at least two partitions per core, for work that is heavy per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def spread_rows(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before an expansion, where the plan before may leave them in few partitions."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
