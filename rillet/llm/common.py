"""What the corpus operators share: scratch tables in the cluster's shared folder, paths and column names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset a local session gets a temporary one (tests), and a
    cluster an error, as its machines would write where no other looks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rillet-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def bound_batches(spark: SparkSession, most: int = 3 << 20) -> None:
    """Texts may be very long, so Arrow batches hold few bytes: what a worker holds at once stays bounded. Plans run after this returns, so
    the session keeps the setting; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < known <= most:
        spark.conf.set(name, str(most))


class Scratch:
    """Intermediate tables, written to the shared folder so that a lost executor costs a re-read and no recomputation."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that clash with those an operator adds: the operator's own columns win, whatever the letter case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def apart(df: DataFrame, run, own: dict[str, str], added: tuple[str, ...]) -> DataFrame:
    """What ``run`` makes of the columns that it works on, under its own names for them (``own``: its name, the caller's), with ``added``. The
    caller's other columns are carried as one and come back as they were, so that no name of theirs meets one of ``run``'s; those that clash with
    the added ones give way."""
    df = make_room(df, *[c for c in added if c not in own.values()])
    others = [c for c in df.columns if c not in own.values()]
    named = lambda c: F.col(f"`{c}`")
    carried = [F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("carried")] if others else []
    out = run(df.select(*[named(c).alias(name) for name, c in own.items()], *carried))
    back = {c: F.col(name).alias(c) for name, c in own.items()} | {c: F.col(f"carried.c{i}").alias(c) for i, c in enumerate(others)}
    return out.select(*[back[c] for c in df.columns if c not in added], *added)


#: Bytes that may be sent to every executor, as Spark's rows.
SMALL_BYTES = 100 << 20


def is_small(df: DataFrame, most: int = SMALL_BYTES) -> bool:
    """Whether a written table is within the bound for sending it to every executor: as rows of a hash table, 24 bytes and 8 a column each, and what
    its texts and arrays have. One pass, map-side, after a count of what can't be small whatever it holds."""
    fixed = 24 + 8 * len(df.columns)
    if df.limit(most // fixed + 1).count() > most // fixed:
        return False
    long = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    lists = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in long), F.lit(fixed)) + sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in lists), F.lit(0))
    return (df.agg(F.sum(size.cast("long"))).head()[0] or 0) <= most


def give_back() -> None:
    """Memory that this process has freed goes back to the machine, where its allocators can do that."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_held: dict = {}


def held(key, make):
    """What ``make`` gives, kept in this worker process until another operator asks for something of its own: workers are used again
    from stage to stage, and their memories must not add up."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]
