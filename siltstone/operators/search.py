"""Vector similarity search and memory queries."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import DimensionMismatchError, ValidationError
from siltstone.functions.vectors import cosine_to, similarity_score
from siltstone.operators.checks import require_empty

# Default result sizes.
SEARCH_LIMIT = 10
MEMORY_LIMIT = 100


def metadata_equals(metadata: Column, key: str, value: Any) -> Column:
    """``metadata[key] == value`` for a VARIANT column, comparing numbers and booleans by value.

    A null value also matches a missing key.
    """
    path = "$['{}']".format(key.replace("'", "\\'"))
    item = F.try_variant_get(metadata, path, "variant")
    kind = F.schema_of_variant(item)
    if value is None:
        return item.isNull() | (kind == "VOID")
    if isinstance(value, (bool, int, float)):
        number = F.try_variant_get(metadata, path, "double")
        truth = F.try_variant_get(metadata, path, "boolean").cast("double")
        found = F.when(kind == "BOOLEAN", truth).when(kind.rlike("\\A(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), number)
        return F.coalesce(found == float(value), F.lit(False))
    text = F.when(kind == "STRING", F.try_variant_get(metadata, path, "string"))
    return F.coalesce(text == value, F.lit(False))


def matches_filter(metadata: Column, wanted: dict[str, Any]) -> Column:
    """All entries of a metadata filter together."""
    condition = F.lit(True)
    for key, value in wanted.items():
        condition = condition & metadata_equals(metadata, key, value)
    return condition


def check_query(query: list[float], limit: int) -> None:
    if not query or not all(math.isfinite(value) for value in query):
        raise ValidationError("the query embedding must be non-empty and finite")
    if limit <= 0:
        raise ValidationError("limit must be positive")


def require_dimensions(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Return ``vectors`` unchanged, or raise when an embedding has another length."""
    wrong = vectors.where(F.size("embedding") != dimensions)
    require_empty(wrong.select("id"), f"embedding without {dimensions} dimensions", DimensionMismatchError)
    return vectors


def _of_length(embedding: Column, dimensions: int) -> Column:
    found = F.concat(F.lit(f"embedding without {dimensions} dimensions: "), F.size(embedding).cast("string"))
    return F.when(F.size(embedding) != dimensions, F.raise_error(found)).otherwise(embedding)


def search(
    vectors: DataFrame,
    query: list[float],
    limit: int = SEARCH_LIMIT,
    condition: Column | None = None,
    dimensions: int | None = None,
) -> DataFrame:
    """The ``limit`` nearest vectors by cosine, scored 0..1, ordered by (-score, id).

    ``vectors`` needs ``id`` and ``embedding``. The filter runs before scoring, the query vector is a literal of
    the plan, and only the best rows of each task are compared globally. A vector of length zero has no
    direction and is never returned. A vector with another number of values than the query's fails the search, in the
    same pass that scores it.
    """
    check_query(query, limit)
    if dimensions is not None and len(query) != dimensions:
        raise DimensionMismatchError("query and collection dimensions differ", expected=dimensions, actual=len(query))
    filtered = vectors if condition is None else vectors.where(condition)
    scored = (
        filtered.withColumn("_cosine", cosine_to(_of_length(F.col("embedding"), len(query)), query))
        .withColumn("score", similarity_score(F.col("_cosine")))
        .drop("_cosine")
    )
    return scored.where("score is not null").orderBy(F.desc("score"), "id").limit(limit)


def memory_query(
    records: DataFrame,
    memory_type: str | None = None,
    entity_id: Any = None,
    metadata_filter: dict[str, Any] | None = None,
    limit: int = MEMORY_LIMIT,
) -> DataFrame:
    """Records meeting every given constraint, by id, at most ``limit``; plain columns are filtered first."""
    if memory_type is not None and not memory_type.strip():
        raise ValidationError("memory_type must not be empty when given")
    if limit <= 0:
        raise ValidationError("limit must be positive")
    if memory_type is not None:
        records = records.where(F.col("memory_type") == memory_type)
    if entity_id is not None:
        records = records.where(F.col("entity_id") == entity_id)
    if metadata_filter:
        records = records.where(matches_filter(F.col("metadata"), metadata_filter))
    return records.orderBy("id").limit(limit)


def top(ordered: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows of an ordered result."""
    if count < 0:
        raise ValidationError("count must not be negative")
    return ordered.limit(count)
