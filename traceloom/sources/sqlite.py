"""Rows of SQLite files as JSON lines: the file's bytes come through Spark's reader and are opened in memory by the
task, so that any store Spark reads will do. Columns that a file lacks are null to from_json."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def rows(spark: SparkSession, paths: list[str] | str, tables: list[str]) -> DataFrame:
    """source_path, table, line_no (of the row in its table), value (JSON). A table a file lacks has no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                for table in tables:
                    if not db.execute("select 1 from sqlite_master where name = ?", (table,)).fetchone():
                        continue
                    cur = db.execute(f'select * from "{table}"')
                    names, n = [d[0] for d in cur.description], 0
                    while got := cur.fetchmany(5_000):
                        text = [json.dumps({k: v.decode("utf-8", "replace") if isinstance(v, bytes) else v for k, v in zip(names, r, strict=True)}) for r in got]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(got)), pa.array([table] * len(got)), pa.array(range(n, n + len(got)), pa.int64()), pa.array(text)], ["source_path", "table", "line_no", "value"])
                        n += len(got)
                db.close()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "content")
    return files.mapInArrow(read, "source_path string, table string, line_no long, value string")
