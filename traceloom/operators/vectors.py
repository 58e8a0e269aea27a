"""Exact vector search and the vector table's rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.segments import Segments


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / F.nullif(size, F.lit(0.0))).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, query: list[float], k: int | None, key: str = "doc_id", column: str = "embedding") -> DataFrame:
    """The k nearest by cosine distance with score 1 / (1 + distance); all, if k is None (a scoped search)."""
    q = F.array(*(F.lit(float(x)) for x in query))
    out = vectors.withColumn("distance", 1 - cosine(F.col(column), q)).withColumn("score", 1 / (1 + F.col("distance")))
    return out if k is None else out.orderBy("distance", key).limit(k)


def hits(found: DataFrame, records: DataFrame, condition: Column, key: str = "doc_id") -> DataFrame:
    """Records of the found vectors; the filter comes after the top k, so fewer than k may remain."""
    return found.select(key, "distance", "score").join(records, key).filter(condition)


def add_vectors(stored: DataFrame, new: DataFrame, dims: int, key: str = "doc_id", column: str = "embedding") -> DataFrame:
    """stored and new vectors; an id that is there keeps its vector; another number of dimensions is an error."""
    sized = new.withColumn(column, F.when(F.size(column) == dims, F.col(column)).otherwise(F.raise_error(F.lit(f"expected {dims} dimensions")).cast(stored.schema[column].dataType)))
    return stored.unionByName(sized.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(stored.columns))


class VectorStore:
    """A stored vector table that knows its model. Vectors of another model or another number of dimensions can't be
    compared, so they go when new ones come; an id that is there keeps its vector, and only new ids are written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.table = spark, Segments(spark, root)

    def _kind(self) -> tuple[str, int] | None:
        """Model and dimensions; all rows have the same."""
        rows = self.table.read()
        row = rows.select("source_path").first() if rows is not None else None
        return (row[0].rsplit(":", 1)[0], int(row[0].rsplit(":", 1)[1])) if row else None

    def read(self) -> DataFrame | None:
        rows = self.table.read()
        return None if rows is None else rows.drop("source_path")

    def add(self, new: DataFrame, model: str, dims: int) -> bool:
        """new: doc_id, embedding. Whether stored vectors were dropped, so that all texts are to be embedded again."""
        kind, name = self._kind(), f"{model}:{dims}"
        held = self.read()
        stale = kind is not None and kind != (model, dims)
        empty = self.spark.createDataFrame([], new.select("doc_id", "embedding").schema)
        rows = add_vectors(empty, new.select("doc_id", "embedding"), dims)
        if held is not None and not stale:
            rows = rows.join(held.select("doc_id"), "doc_id", "left_anti").select("doc_id", "embedding")
        rows = rows.withColumn("source_path", F.lit(name))
        if stale:
            self.table.replace_files(rows, self.spark.createDataFrame([(f"{kind[0]}:{kind[1]}",)], "source_path string"))
        else:
            self.table.append(rows)
        return stale or kind is None

    def query_model(self, configured: str) -> str | None:
        """The model that a query is embedded with: the stored vectors' own, the configured one where it isn't known;
        none without vectors."""
        kind = self._kind()
        return None if kind is None else kind[0] or configured

    def search(self, query: str, k: int, embed: Callable[[str, str], list[float]], lexical: Callable[[str], DataFrame], configured: str) -> DataFrame:
        """The k nearest to the query as embed(model, query) places it; without vectors, what lexical(query) finds."""
        model = self.query_model(configured)
        return lexical(query) if model is None else nearest(self.read(), embed(model, query), k)
