"""The node table in versions: indexing one document again writes its own rows and nothing else.

A write appends its rows (``rows/attempt=…/doc_bucket=…``), one manifest row per touched document
(``manifest/attempt=…``, a tombstone where it was deleted), and last one commit row (``commits``). Scans read commits
only, so what a killed write left behind is never seen and the write can be repeated. ``compact`` writes the current rows
as a new base, from which scans start; folders of older attempts are no longer read. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from arbora.sources.nodes import BUCKETS, with_bucket

COMMIT = "version int, attempt string, base boolean, buckets int, has_rows boolean, node_schema string"
MANIFEST = "document_id string, deleted boolean, node_version int"
#: Columns the table adds to the nodes.
OWN = ("node_version", "attempt", "doc_bucket")


def commits(spark: SparkSession, path: str) -> list[Row]:
    """Commits from the last base on, oldest first: one small row per write since then."""
    try:
        log = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    start = log.where("base").agg(F.max("version")).first()[0]
    return log.where(F.col("version") >= F.lit(start)).orderBy("version").collect()


def _stored_schema(made: list[Row]) -> StructType:
    return StructType.fromJson(json.loads(made[-1]["node_schema"]))


def _attempts(spark: SparkSession, path: str, kind: str, schema: StructType | str, made: list[Row]) -> DataFrame:
    if not made:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/{kind}/attempt={m['attempt']}" for m in made]
    return spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(*folders)


def _node_rows(spark: SparkSession, path: str, made: list[Row]) -> DataFrame:
    fields = _stored_schema(made).fields
    own = [StructField("node_version", IntegerType()), StructField("attempt", StringType()), StructField("doc_bucket", IntegerType())]
    return _attempts(spark, path, "rows", StructType([*fields, *own]), [m for m in made if m["has_rows"]])


def read_current(spark: SparkSession, path: str, document_id: str | None = None) -> DataFrame:
    """The nodes as of the last commit; with ``document_id`` only that document's bucket is read.

    Rows of the base stay unless their document was touched later; later rows count if they are the document's latest.
    The manifest since the base, one row per touched document, is the small side of the one join.
    """
    made = commits(spark, path)
    if not made:
        raise ValueError(f"no node table at {path}")
    rows = _node_rows(spark, path, made)
    if document_id is not None:
        bucket = F.pmod(F.xxhash64(F.lit(document_id)), F.lit(made[0]["buckets"])).cast("int")
        rows = rows.where((F.col("doc_bucket") == bucket) & (F.col("document_id") == document_id))
    if len(made) > 1:
        later = _attempts(spark, path, "manifest", MANIFEST, made[1:])
        last = later.groupBy(F.col("document_id").alias("__doc")).agg(F.max(F.struct("node_version", "deleted")).alias("__last"))
        joined = rows.join(last, F.col("document_id").eqNullSafe(F.col("__doc")), "left")
        base = F.col("__last").isNull() & (F.col("node_version") == made[0]["version"])
        latest = (F.col("node_version") == F.col("__last.node_version")) & ~F.col("__last.deleted")
        rows = joined.where(base | F.coalesce(latest, F.lit(False))).drop("__doc", "__last")
    return rows.drop(*OWN)


def _commit(spark: SparkSession, path: str, made: list[Row], attempt: str, base: bool, buckets: int, has_rows: bool, schema: StructType) -> None:
    version = made[-1]["version"] + 1 if made else 1
    row = [(version, attempt, base, buckets, has_rows, schema.json())]
    spark.createDataFrame(row, COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _schema(nodes: DataFrame, made: list[Row]) -> StructType:
    """Columns of the table so far, then new ones; a column that a write lacks is null there."""
    fields = list(_stored_schema(made).fields) if made else []
    known = {f.name: f.dataType for f in fields}
    for f in nodes.schema.fields:
        if f.name in OWN:
            raise ValueError(f"{f.name} is a column of the node table itself")
        if known.get(f.name, f.dataType) != f.dataType:
            raise ValueError(f"{f.name} is {known[f.name].simpleString()} in the node table, not {f.dataType.simpleString()}")
    return StructType([*fields, *(StructField(f.name, f.dataType) for f in nodes.schema.fields if f.name not in known)])


def _write_rows(nodes: DataFrame, path: str, attempt: str, version: int, buckets: int) -> None:
    rows = with_bucket(nodes, buckets).withColumn("node_version", F.lit(version))
    balanced = rows.hint("rebalance", "doc_bucket").sortWithinPartitions("doc_bucket", "document_id")
    balanced.write.partitionBy("doc_bucket").parquet(f"{path}/rows/attempt={attempt}")


def replace_documents(nodes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The documents of ``nodes`` have these rows from now on; other documents are neither read nor written.

    ``buckets`` counts for a new table only, an existing one keeps its own number. Without rows nothing changes.
    """
    spark = nodes.sparkSession
    made, attempt = commits(spark, path), uuid.uuid4().hex
    version, buckets = (made[-1]["version"] + 1, made[0]["buckets"]) if made else (1, buckets)
    schema = _schema(nodes, made)
    _write_rows(nodes, path, attempt, version, buckets)
    written = spark.read.schema("document_id string").parquet(f"{path}/rows/attempt={attempt}")
    if written.isEmpty():
        return
    touched = written.distinct().select("document_id", F.lit(False).alias("deleted"), F.lit(version).alias("node_version"))
    touched.write.parquet(f"{path}/manifest/attempt={attempt}")
    _commit(spark, path, made, attempt, not made, buckets, True, schema)


def delete_documents(spark: SparkSession, path: str, documents: DataFrame) -> None:
    """Tombstones for the documents; no row is read or written again."""
    made, attempt = commits(spark, path), uuid.uuid4().hex
    if not made:
        return
    version = made[-1]["version"] + 1
    gone = documents.select("document_id").distinct().select("document_id", F.lit(True).alias("deleted"), F.lit(version).alias("node_version"))
    gone.write.parquet(f"{path}/manifest/attempt={attempt}")
    _commit(spark, path, made, attempt, False, made[0]["buckets"], False, _stored_schema(made))


def compact(spark: SparkSession, path: str) -> None:
    """Write the current rows as a new base."""
    made, attempt = commits(spark, path), uuid.uuid4().hex
    if len(made) < 2:
        return
    current, version = read_current(spark, path), made[-1]["version"] + 1
    _write_rows(current, path, attempt, version, made[0]["buckets"])
    has_rows = not spark.read.schema("document_id string").parquet(f"{path}/rows/attempt={attempt}").isEmpty()
    _commit(spark, path, made, attempt, True, made[0]["buckets"], has_rows, current.schema)
