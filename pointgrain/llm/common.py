"""What several operators of this package share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of most contracts is a run of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Elements that a fold appends to one list before it begins another.
CHUNK = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only local sessions may lack one and get their own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at or tempfile.mkdtemp(prefix="spark-")


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a small derived table: a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, since a batch of whole texts is held in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def packed(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """Columns of df (all by default) as one struct: the caller's names cannot clash with an operator's own."""
    chosen = df.columns if names is None else names
    return F.struct(*(F.col(f"`{c}`") for c in chosen)) if chosen else F.struct(F.lit(True).alias("none"))


def named(names: Sequence[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col(f"`{c}`") for c in names]


def unpacked(names: Sequence[str], struct: str = "own") -> list[Column]:
    """The columns that packed has put into a struct."""
    return [F.col(struct)[c].alias(c) for c in names]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names: an operator's own outputs replace columns of the same name."""
    clash = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in clash))


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """64 bits of a row's contents. Maps have no hash and are left out."""
    kinds = dict(df.dtypes)
    return F.xxhash64(*(F.col(f"`{c}`") for c in columns or df.columns if "map<" not in kinds[c] and kinds[c] != "variant"))


def search(bounds: Sequence, key: Column) -> Column:
    """How many of the sorted bounds are at most key: a binary search in one expression. 0 for a null key."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    array = F.array(*map(F.lit, bounds)) if len(bounds) < 3 else F.lit(list(bounds))
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= key, at + step).otherwise(at))


def bucket_count(spark: SparkSession) -> int:
    """Key ranges for prefix sums: a few for each shuffle partition, so that a range stays small as the cluster grows."""
    return min(8192, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def walk(items: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Folds an array from its left: step(at, x) gives a struct of the next at (an int, 0 at first) and out (an array of
    this kind of elements). Returns the last at and all out in one array. Lists of CHUNK elements are gathered in a list
    of lists, since appending to one long list would copy it each time."""

    def append(acc, x):
        return bound(step(acc["at"], x), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))

    def gather(acc, chunk):
        begin = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return bound(F.aggregate(chunk, begin, append), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    last = lambda a: F.floor((F.greatest(F.size(a), F.lit(1)) - 1) / CHUNK).cast("int")
    chunks = bound(items, lambda a: F.transform(F.sequence(F.lit(0), last(a)), lambda i: F.slice(a, i * CHUNK + 1, F.lit(CHUNK))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(chunks, start, gather, lambda acc: F.struct(acc["at"].alias("at"), F.flatten(acc["out"]).alias("out")))
