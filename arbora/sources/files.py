"""Raw document files and stored layout payloads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = "document_id STRING, page_number INT"
BOX = "x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE"

# Schemas of the layout tables, stated so that nothing is inferred.
LAYOUT_SCHEMAS = {
    "pages": f"{PAGE}, width DOUBLE, height DOUBLE",
    "words": f"{PAGE}, text STRING, {BOX}",
    "chars": f"{PAGE}, size DOUBLE, fontname STRING, {BOX}",
    "lines": f"{PAGE}, line_no INT, text STRING, font_size DOUBLE, bold BOOLEAN, {BOX}",
    "images": f"{PAGE}, {BOX}",
    "tables": f"{PAGE}, table_index INT, rows ARRAY<ARRAY<STRING>>, {BOX}",
}


def scan_files(spark: SparkSession, path: str, glob: str = "*", most: int | None = None) -> DataFrame:
    """Files as rows: path, length, modification time, content and its digest.

    Files over ``most`` bytes (as given, or what Spark takes as one value) come without content, and their digest is taken
    while they are read piece by piece; that needs a path that every machine opens as a file. On other
    file systems Spark reads each file as one value.
    """
    scheme = urlsplit(path).scheme or urlsplit(spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")).scheme
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    )
    if scheme != "file":
        return files.withColumn("content_sha256", F.sha2("content", 256))
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    most = limit if most is None else min(most, limit)
    whole = files.filter(F.col("length") <= most).withColumn("content_sha256", F.sha2("content", 256))
    large = files.filter(F.col("length") > most).drop("content")
    digests = large.mapInArrow(with_digests, "path string, modificationTime timestamp, length long, content_sha256 string")
    return whole.unionByName(digests.withColumn("content", F.lit(None).cast("binary")))


def with_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the SHA-256 of the file at ``path``, of which a small piece is in memory at a time."""
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            with open(path.removeprefix("file:"), "rb") as file:  # paths come as they are, nothing in them is escaped
                digests.append(hashlib.file_digest(file, "sha256").hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "content_sha256"])


def scan_layout(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """One layout table (pages, words, chars, lines, images or tables) with its fixed schema."""
    schema = T.StructType.fromDDL(LAYOUT_SCHEMAS[table])
    return spark.read.schema(schema).format(fmt).load(f"{path}/{table}")
