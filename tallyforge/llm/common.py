"""What the operators share: the written tables that cut lineage, text canonicalisation, folds and samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch: with Spark's 10,000, a batch of whole documents is some 100 MB in a worker, and as much in the JVM.
BATCH_ROWS = 1000
#: Parts in which the hashes of a class are ranked before the last ranking, so that no class is one task's work.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir, which all executors share.

    Only on one machine (tests), where the session names none, is a temporary folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyforge-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tallyforge-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Have texts go to Python workers BATCH_ROWS at a time, in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no rerun."""
    path = shared_dir(df.sparkSession)
    small_batches(df.sparkSession)
    # Spark 4.1 takes a union of sides placed by one key to be placed by it, but may coalesce the sides differently.
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialise() that no later result reads."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path.getFileSystem(conf).delete(path, True)


def dealt(df: DataFrame) -> DataFrame:
    """df, its rows dealt out anew if it comes in fewer parts than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores where columns of df have them, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def with_uid(df: DataFrame, name: str = "uid") -> DataFrame:
    """A unique long for each row, also of repeated rows. Stable once the table is written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def slices(batches: Iterator[pd.DataFrame], column: str, limit: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cut batches so that the texts of each slice have about `limit` characters; one longer text stays whole."""
    for batch in batches:
        if batch.empty:
            continue
        size = batch[column].str.len().fillna(0).to_numpy()
        block = (size.cumsum() // limit).astype("int64")
        if block[-1] == 0:
            yield batch
            continue
        for _, part in batch.groupby(block, sort=True):
            yield part.reset_index(drop=True)


def bounded_sample(df: DataFrame, key: Column, limit: int, by: list[str] | None = None) -> DataFrame:
    """Rows whose key is among the `limit` smallest xxhash64 of the key, in each class of `by`.

    Only the hashes travel to find each class's threshold; texts are read again for the rows under it. Ties on
    the threshold come in too, so `limit` is exceeded by equal keys at most. Each of SALTS parts of a class keeps its
    own `limit` first, so the last ranking of a class has at most SALTS times that many rows, however large it is.
    """
    mark = F.xxhash64(key)
    named = {f"__by{i}": F.col(c) for i, c in enumerate(by or [])}
    groups = [F.col(c) for c in named] or [F.lit(0)]
    narrow = df.select(mark.alias("__mark"), *[c.alias(n) for n, c in named.items()]).distinct()
    for parts in ([F.pmod("__mark", F.lit(SALTS))], []):
        rank = F.row_number().over(Window.partitionBy(*groups, *parts).orderBy("__mark"))
        narrow = narrow.withColumn("__rank", rank).filter(F.col("__rank") <= limit).drop("__rank")
    edges = narrow.groupBy(*named).agg(F.max("__mark").alias("__edge")).collect()
    if not edges:
        return df.limit(0)
    test = F.lit(False)
    for e in edges:
        here = mark <= F.lit(e["__edge"])
        for n, c in named.items():
            here = here & c.eqNullSafe(F.lit(e[n]))
        test = test | here
    return df.filter(test)


def record_batches(rows: Iterator[tuple], kind: str, limit: int = 10_000, characters: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches with the columns of `kind`, of at most so many rows and about so many characters."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, types[type_]) for name, type_ in map(str.split, kind.split(", "))])
    some, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        some.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(some) >= limit or size >= characters:
            yield batch()
            some, size = [], 0
    if some:
        yield batch()


def streamed(rows: DataFrame, by: list[str], order: list[str], columns: list[str], walk: Callable[[Iterator[tuple]], Iterator[tuple]], kind: str) -> DataFrame:
    """What `walk` makes of the columns of each group of equal `by`, in order: one shuffle and one sort, rows as they come."""
    rows.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")  # see materialise()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return record_batches(walk(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), kind)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).select(*columns).mapInArrow(run, kind)
