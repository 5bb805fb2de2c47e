"""Entity relations: schemas, JSON documents, and status transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import ValidationError

_STAMPS = "created_at timestamp, updated_at timestamp"
# Column names and types of the entity relations.
SCHEMAS = {
    "repositories": "id string, name string, source_uri string, provider string, default_branch string, "
    f"status string, metadata variant, {_STAMPS}",
    "source_files": f"id string, repository_id string, relative_path string, language string, size_bytes bigint, metadata variant, {_STAMPS}",
    "analysis_runs": "id string, repository_id string, status string, started_at timestamp, completed_at timestamp, "
    f"error_message string, {_STAMPS}",
    "findings": "id string, analysis_run_id string, category string, message string, source_file_id string, "
    f"severity string, score double, metadata variant, {_STAMPS}",
}
# Allowed transitions, action -> (statuses it may start from, status it leads to).
TRANSITIONS = {
    "repository": {
        "mark_collecting": (["pending"], "collecting"),
        "mark_ready": (["collecting"], "ready"),
        "mark_failed": (["pending", "collecting"], "failed"),
    },
    "run": {
        "start": (["pending"], "running"),
        "complete": (["running"], "completed"),
        "fail": (["pending", "running"], "failed"),
        "cancel": (["pending", "running"], "cancelled"),
    },
}


def iso_text(moment: Column) -> Column:
    """UTC timestamp as ISO-8601 with offset; microseconds only when there are any."""
    whole = F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(moment), F.lit(1_000_000))
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(whole, fraction, F.lit("+00:00"))


def iso_moment(text: Column) -> Column:
    return F.to_timestamp(text)


def _fields(relation: str) -> dict[str, str]:
    return dict(field.split(" ") for field in SCHEMAS[relation].split(", "))


def to_documents(rows: DataFrame, relation: str) -> DataFrame:
    """(id, document): one JSON object per entity, timestamps as ISO text, nulls written out."""
    fields = [
        (iso_text(F.col(name)) if kind == "timestamp" else F.col(name)).alias(name)
        for name, kind in _fields(relation).items()
    ]
    return rows.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def from_documents(documents: DataFrame, relation: str) -> DataFrame:
    """Entities from their JSON documents."""
    kinds = _fields(relation)
    raw = ", ".join(f"{name} {'string' if kind == 'timestamp' else kind}" for name, kind in kinds.items())
    parsed = documents.select(F.from_json("document", raw).alias("d"))
    return parsed.select(
        *[
            (iso_moment(F.col(f"d.{name}")) if kind == "timestamp" else F.col(f"d.{name}")).alias(name)
            for name, kind in kinds.items()
        ]
    )


def duration_seconds(started: Column, completed: Column) -> Column:
    """Seconds between two moments; null when one is missing."""
    return (F.unix_micros(completed) - F.unix_micros(started)) / F.lit(1e6)


def run_snapshots(runs: DataFrame) -> DataFrame:
    """Analysis runs with their duration."""
    return runs.withColumn("duration_seconds", duration_seconds(F.col("started_at"), F.col("completed_at")))


def touch(rows: DataFrame, moment: Column | None = None) -> DataFrame:
    return rows.withColumn("updated_at", F.current_timestamp() if moment is None else moment)


def attempt_transition(
    rows: DataFrame, entity: str, action: str, moment: Column | None = None, reason: str | None = None
) -> DataFrame:
    """Apply an action where the status allows it; ``applied`` tells where it did."""
    if action not in TRANSITIONS.get(entity, {}):
        raise ValidationError(f"{entity} has no action '{action}'")
    sources, target = TRANSITIONS[entity][action]
    moment = F.current_timestamp() if moment is None else moment
    applied = F.col("status").isin(sources)
    changes: dict[str, Column] = {
        "applied": applied,
        "status": F.when(applied, target).otherwise(F.col("status")),
    }
    if "updated_at" in rows.columns:
        changes["updated_at"] = F.when(applied, moment).otherwise(F.col("updated_at"))
    if entity == "run":
        stamp = "started_at" if action == "start" else "completed_at"
        changes[stamp] = F.when(applied, moment).otherwise(F.col(stamp))
        if action == "fail":
            changes["error_message"] = F.when(applied, F.lit(reason)).otherwise(F.col("error_message"))
    elif action == "mark_failed":
        merged = F.map_concat(
            F.map_filter(F.from_json(F.to_json("metadata"), "map<string,variant>"), lambda key, _: key != "failure_reason"),
            F.create_map(F.lit("failure_reason"), F.lit(reason).cast("variant")),
        )
        changes["metadata"] = F.when(applied, F.parse_json(F.to_json(merged))).otherwise(F.col("metadata"))
    return rows.withColumns(changes)


def transition(rows: DataFrame, entity: str, action: str, moment: Column | None = None, reason: str | None = None) -> DataFrame:
    """Apply an action to every row; the job fails on a row whose status does not allow it."""
    checked = F.when(F.col("applied"), F.col("applied")).otherwise(
        F.raise_error(F.concat(F.lit(f"cannot {action} a {entity} in status "), F.col("status"))).cast("boolean")
    )
    attempted = attempt_transition(rows, entity, action, moment, reason)
    return attempted.where(checked).drop("applied")
