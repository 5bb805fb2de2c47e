"""Canonical JSON and its checksum."""

from __future__ import annotations

import hashlib
import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _canonical(text: str | None) -> str | None:
    """JSON text with sorted keys, no blanks and ASCII escapes."""
    return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))


def _canonical_batch(texts: pa.Array) -> pa.Array:
    return pa.array([_canonical(text) for text in texts.to_pylist()], pa.string())


def _checksum_batch(texts: pa.Array) -> pa.Array:
    canonical = [_canonical(text) for text in texts.to_pylist()]
    return pa.array([text and hashlib.sha256(text.encode()).hexdigest() for text in canonical], pa.string())


cloudpickle.register_pickle_by_value(sys.modules[__name__])

_canonical_udf = F.arrow_udf(_canonical_batch, StringType())
_checksum_udf = F.arrow_udf(_checksum_batch, StringType())


def canonical_json(document: Column) -> Column:
    """Canonical form of a JSON text column. Spark's own writer differs in key order, nulls and escapes."""
    return _canonical_udf(document)


def export_checksum(document: Column) -> Column:
    """SHA-256 of the canonical form, 64 lower-case hex digits."""
    return _checksum_udf(document)
