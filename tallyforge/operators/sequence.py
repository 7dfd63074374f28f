"""Work that needs the rows of a group one after the other: one shuffle, one sort, and a walk through the sorted rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32()}


def plain_unions(spark: SparkSession) -> None:
    """Have unions place rows anyhow, as before Spark 4.1.

    Since then a union of sides that are placed by the same key is taken to be placed by it too, but adaptive execution
    may coalesce the sides differently: rows of a key then stay apart (seen in 4.1.2 as wrong groups, or as an error).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def settled(rows: DataFrame) -> DataFrame:
    """rows, written below the folder that the session names in spark.checkpoint.dir and read back: computed once, lineage cut.

    Only on one machine (tests), where the session names none, is a temporary folder made and set.
    """
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyforge-")
        spark.sparkContext.setCheckpointDir(base)
    plain_unions(spark)
    path = f"{base.rstrip('/')}/tallyforge-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Rows that a task gets, on average, where rows are dealt by their number.
ROWS_A_TASK = 250_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks over which rows are dealt so that one's memory does not grow with the input; counts the rows."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() // ROWS_A_TASK))


def by_size(rows: DataFrame, least: int, by: str = "statement_id") -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups below `least` rows, rows of the others or None if there are none); null groups are among the first."""
    large = rows.groupBy(by).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(by).filter(F.col(by).isNotNull())
    if large.isEmpty():
        return rows, None
    large = settled(large)
    return rows.join(large, by, "left_anti"), rows.join(large, by, "left_semi")


def walked(rows: DataFrame, by: list[str], order: list[str], walk: Callable[[Iterator[tuple]], Iterator[tuple]], kind: str, placed: bool = False) -> DataFrame:
    """What `walk` yields, with the columns of `kind`, from the rows as tuples in their order.

    A task holds many groups (equal `by`), which reach the walk one after the other; it sees a new group by its key.
    Rows stream through sorted batches, so a group is never held whole but for what the walk keeps of it. placed: rows come
    from windows over `by` alone, which left each group in one task.
    """
    plain_unions(rows.sparkSession)
    fields = [f.split() for f in kind.split(", ")]
    schema = pa.schema([(name, _ARROW[type_]) for name, type_ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tuples = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found = walk(tuples)
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return (rows if placed else rows.repartition(*by)).sortWithinPartitions(*by, *order).mapInArrow(run, kind)
