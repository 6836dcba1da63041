"""Reading tables and joining lookups whose size is checked, not assumed."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup is broadcast only if it has at most this many rows and bytes: the driver holds several at once, each a few times over.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20
#: Rows that one task looks at in an order of its own.
SHARD_ROWS = 1_000_000
#: The shared folder of each session.
_OWN: dict[SparkSession, str] = {}
#: Copies of a larger lookup's rows, so that one hot key is spread over as many tasks.
SALTS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_most(df: DataFrame, rows: int, most_bytes: int | None = None) -> bool:
    """Whether df has at most ``rows`` rows, and these at most ``most_bytes`` bytes; reads no more than it needs to decide."""
    part = df.limit(rows + 1)
    if most_bytes is None:
        return part.count() <= rows
    wide = [F.octet_length(c) if t == "string" else F.octet_length(F.to_json(F.struct(c))) for c, t in df.dtypes if t == "string" or "<" in t]
    size = F.coalesce(F.sum(sum((F.coalesce(c, F.lit(0)) for c in wide), F.lit(8 * len(df.columns)))), F.lit(0))
    n, b = part.agg(F.count("*"), size).first()
    return n <= rows and b <= most_bytes


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Equi-join of a skewed table with a lookup table.

    The lookup is broadcast while it has at most ``max_rows`` rows and BROADCAST_BYTES bytes. Beyond that both sides are shuffled on
    (keys, salt): the lookup's rows are repeated once per salt, so a key with a third of ``big`` is spread
    over ``salts`` tasks (1 for keys that no side repeats much), and merged: the planner estimates the copies by the compressed file they come from, and would
    broadcast millions of them through the driver. Null keys match nothing. ``how`` is inner, left, left_semi or left_anti.
    """
    if at_most(small, max_rows, BROADCAST_BYTES):
        return big.join(F.broadcast(small), keys, how)
    if salts == 1:
        return big.join(small.hint("merge"), keys, how)
    salt = "__salt"
    salted = big.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*keys, salt], how).drop(salt)


def shards_for(rows: int, least: int = 8) -> int:
    """How many shards so many rows are cut into, so that each has about SHARD_ROWS."""
    return max(least, -(-rows // SHARD_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """df in enough partitions for all cores, for steps that cost much per row: small inputs come in few.

    Decided by the planner's estimate of the size, which runs no job; what is larger than all cores' scan partitions is
    left as it is, without an exchange.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(3 * cores) if size < 2 * cores * df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application that all executors share: below spark.checkpoint.dir, or, where that is unset and the
    executors are threads of this machine, a temporary one. What is written there is deleted by release().

    On a cluster without spark.checkpoint.dir there is no such folder, and a ValueError.
    """
    if spark not in _OWN:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[spark] = f"{named.rstrip('/')}/obslake-{spark.sparkContext.applicationId}" if named else "file://" + tempfile.mkdtemp(prefix="obslake-")
        atexit.register(release, spark)
    return _OWN[spark]


def release(spark: SparkSession) -> None:
    """Deletes what steps of this session wrote to the shared folder; frames that read it can't be used any more. Called at
    the end of the program, where it does what is still possible."""
    folder = _OWN.pop(spark, None)
    if not folder:
        return
    context = spark.sparkContext
    if context._jsc is None and not folder.startswith(("/", "file:/")):
        print(f"obslake: {folder} is left, for the session has ended", file=sys.stderr)
    elif context._jsc is None:
        shutil.rmtree("/" + folder.removeprefix("file:").lstrip("/"), True)
    else:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to the shared folder as a table.

    Cuts the lineage: what is lost with an executor is read again, not computed again. Written as columns, so that later
    steps read only those they need.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
