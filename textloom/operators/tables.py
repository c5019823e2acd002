"""Tables that are written once and read again, typed storage with schema checks, and dense numbering without a single task."""

from __future__ import annotations

import itertools
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W


class InvalidFormat(ValueError):
    """The data isn't a table of this kind."""


class InvalidTypeInfo(ValueError):
    """The table's schema isn't the expected one."""


#: Paths handed out since the innermost `scratch` began.
_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. On a cluster it must be set: no folder of this machine would do. Only a local session, which has no other machine,
    gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, below one for this application."""
    path = f"{shared_dir(spark)}/textloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all work tables of this application; what still refers to them can't be computed any more."""
    remove(spark, f"{shared_dir(spark)}/textloom-{spark.sparkContext.applicationId}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the work tables that came within it: results must have been written elsewhere, or with a path from outside."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def materialised(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors. The table stays until `clear`, or the end of a `scratch` around it."""
    path = path or work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def schema_json(schema: T.StructType) -> str:
    return schema.json()


def schema_of_json(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def plain(kind: T.DataType) -> T.DataType:
    """The type with every part nullable, as files keep it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, plain(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(plain(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(plain(kind.keyType), plain(kind.valueType), True)
    return kind


def schema_equal(a: T.StructType, b: T.StructType) -> bool:
    """Names, order and types; what may be null is left aside."""
    return plain(a) == plain(b)


def schema_print(schema: T.StructType) -> str:
    return schema.treeString()


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Parquet and ORC keep the schema in every file."""
    df.write.mode("overwrite").format(format).save(path)


def read_table(spark: SparkSession, path: str, expected: T.StructType, format: str = "parquet") -> DataFrame:
    """The table, if its schema is the expected one; InvalidFormat for other data, InvalidTypeInfo for another schema."""
    try:
        df = spark.read.format(format).load(path)
    except Exception as e:
        raise InvalidFormat(f"{path}: {type(e).__name__}") from e
    if not schema_equal(df.schema, expected):
        raise InvalidTypeInfo(f"{df.schema.simpleString()} instead of {expected.simpleString()}")
    return df


def share(df: DataFrame, column: str, ref: str = "ref") -> tuple[DataFrame, DataFrame]:
    """Equal values of a column, which rows point to, as objects of their own: (df with `ref` in place of the column, objects with `ref` and the column). A null points to nothing. Both are
    ordinary tables, and an object is kept once however many rows point to it."""
    objects = materialised(df.where(F.col(column).isNotNull()).select(column).distinct().withColumn(ref, F.monotonically_increasing_id()), "objects")
    rows = df.join(objects.withColumnRenamed(column, "_object"), F.col(column) == F.col("_object"), "left").drop(column, "_object")
    return rows, objects


def unshare(rows: DataFrame, objects: DataFrame, ref: str = "ref") -> DataFrame:
    """The rows with the objects that they point to."""
    return rows.join(objects, ref, "left").drop(ref)


def reachable(nodes: DataFrame, links: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """nodes: id and others; links: id, to: a record's pointers, cycles and shared ones included, and null ones, which point to nothing; roots: id -> the nodes that a walk from the roots meets, each
    once. Rounds are joins with the nodes met last, as many as the longest of the shortest ways has steps; what a round meets is written once, beside the rounds before. More than `most` rounds, if
    given, are an error."""
    spark, path = nodes.sparkSession, work_path(nodes.sparkSession, "met")
    kind = roots.schema["id"].dataType.simpleString()
    links = materialised(links.where(F.col("to").isNotNull()).select("id", F.col("to").cast(kind).alias("to")), "links")
    new = roots.where(F.col("id").isNotNull()).select("id").distinct()
    for k in itertools.count():
        new.write.parquet(f"{path}/round={k}")
        last = spark.read.schema(f"id {kind}").parquet(f"{path}/round={k}")
        met = spark.read.schema(f"id {kind}, round int").parquet(path).select("id")
        if last.isEmpty():
            return nodes.join(met, "id", "left_semi")
        if most is not None and k >= most:
            raise InvalidFormat(f"pointers lead further than {most} steps")
        new = links.join(last, "id").select(F.col("to").alias("id")).distinct().join(met, "id", "left_anti")


def numbered(df: DataFrame, *order: str, name: str = "ord", start: int = 0) -> DataFrame:
    """df with dense numbers in the given order. Rows are range-partitioned, numbered inside their partitions, and moved by the counts of the partitions before; only these counts
    (a row for each partition) are summed in one place."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    part = materialised(part.select("*", F.shiftright("_at", 33).alias("_part")), "numbered")
    ahead = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    counts = part.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    out = part.join(F.broadcast(counts), "_part")
    return out.withColumn(name, F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1) + start).drop("_part", "_at", "_ahead")


def running(df: DataFrame, order: str, value: str, name: str = "running") -> DataFrame:
    """df with the running sum of value along order (dense numbers from 0): sums of blocks first, then inside the blocks."""
    block = F.col(order).cast("long").bitwiseAND(~0xFFFF)
    blocks = df.groupBy(block.alias("_b")).agg(F.sum(value).alias("_s"))
    ahead = W.Window.orderBy("_b").rowsBetween(W.Window.unboundedPreceding, -1)
    blocks = blocks.select("_b", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_ahead"))
    inside = W.Window.partitionBy("_b").orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    out = df.withColumn("_b", block).withColumn("_in", F.sum(value).over(inside)).join(blocks, "_b")
    return out.withColumn(name, F.col("_ahead") + F.col("_in")).drop("_b", "_in", "_ahead")
