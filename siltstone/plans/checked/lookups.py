"""Vector search, memory queries, keyed tables, status transitions, JSON records and repository references."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.vectors import cosine_to, similarity_score
from siltstone.operators import records, search, store
from siltstone.operators.keyed import create_keyed
from siltstone.plans.checked import query, table
from siltstone.session import checkpoint_folder
from siltstone.sources.collectors import collect_hosted


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _first_vector(spark: SparkSession, folder: str) -> list[float]:
    """The query: the embedding with id 0, one row."""
    return [float(value) for value in _vectors(spark, folder).where("id = 0").first().embedding]


_COSINE = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0))"
_SCORE = f"greatest(0.0, least(1.0, ({_COSINE} + 1) / 2))"


@query("vector_top", f"select vec_id as id, round({_SCORE}, 6) as score from embeddings order by {_SCORE} desc, vec_id limit 20")
def vector_top(spark: SparkSession, folder: str) -> DataFrame:
    found = search.search(_vectors(spark, folder), _first_vector(spark, folder), 20)
    return found.select("id", F.round("score", 6).alias("score"))


@query(
    "vector_top_filtered",
    f"select vec_id as id, round({_SCORE}, 6) as score from embeddings where label = 5 order by {_SCORE} desc, vec_id limit 10",
)
def vector_top_filtered(spark: SparkSession, folder: str) -> DataFrame:
    found = search.search(_vectors(spark, folder), _first_vector(spark, folder), 10, F.col("label") == 5)
    return found.select("id", F.round("score", 6).alias("score"))


@query(
    "vector_scores",
    f"select vec_id as id, round({_SCORE}, 6) as score, len(embedding)::bigint as dimensions from embeddings where {_COSINE} is not null",
)
def vector_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every vector, unranked."""
    cosine = cosine_to(F.col("embedding"), _first_vector(spark, folder))
    return (
        _vectors(spark, folder)
        .select("id", cosine.alias("cosine"), F.size("embedding").cast("bigint").alias("dimensions"))
        .where("cosine is not null")
        .select("id", F.round(similarity_score(F.col("cosine")), 6).alias("score"), "dimensions")
    )


def _memory(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("memory_type"),
        F.col("user_id").alias("entity_id"),
        F.parse_json("props").alias("metadata"),
        "value",
    )


@query(
    "memory_query",
    """select event_id as id, event_type as memory_type from events where event_type = 'click'
    and json_extract_string(props, '$.k')::bigint = 5 order by event_id limit 100""",
)
def memory_query(spark: SparkSession, folder: str) -> DataFrame:
    found = search.memory_query(_memory(spark, folder), memory_type="click", metadata_filter={"k": 5.0})
    return found.select("id", "memory_type")


@query(
    "memory_by_entity",
    "select event_id as id, event_type as memory_type from events where user_id = 8 and json_extract(props, '$.absent') is null order by event_id limit 40",
)
def memory_by_entity(spark: SparkSession, folder: str) -> DataFrame:
    found = search.memory_query(_memory(spark, folder), entity_id=8, metadata_filter={"absent": None}, limit=40)
    return found.select("id", "memory_type")


@query(
    "memory_matches",
    """select event_id as id, json_extract_string(props, '$.k')::bigint = 7 as by_number, false as by_text,
    false as by_missing from events""",
)
def memory_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The predicate itself on every record: a number matches by value, text never equals a number."""
    metadata = F.col("metadata")
    return _memory(spark, folder).select(
        "id",
        search.metadata_equals(metadata, "k", 7).alias("by_number"),
        search.metadata_equals(metadata, "k", "7").alias("by_text"),
        search.metadata_equals(metadata, "k", None).alias("by_missing"),
    )


@query("get_by_key", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 77")
def get_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return store.get(table(spark, folder, "orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("list_by_parent", "select o_orderkey, o_custkey from orders where o_custkey = 42")
def list_by_parent(spark: SparkSession, folder: str) -> DataFrame:
    return store.list_by(table(spark, folder, "orders"), "o_custkey", 42).select("o_orderkey", "o_custkey")


@query(
    "upsert_latest",
    """select user_id, event_id, event_type, round(value, 6) as value from events
    qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
)
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    latest = store.latest_rows(table(spark, folder, "events"), "user_id", ["ts", "event_id"])
    return latest.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query(
    "upsert_rows",
    """with n as (select user_id as c_custkey, value as c_acctbal from events
      qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
    select c_custkey, round(coalesce(n.c_acctbal, c.c_acctbal), 6) as c_acctbal from customer c full join n using (c_custkey)""",
)
def upsert_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Customer balances overwritten, or inserted, by the latest event of a user."""
    customers = table(spark, folder, "customer").selectExpr("c_custkey", "c_acctbal", "cast(null as timestamp_ntz) as ts", "0L as event_id")
    events = table(spark, folder, "events").selectExpr("user_id as c_custkey", "value as c_acctbal", "cast(ts as timestamp_ntz) as ts", "event_id")
    merged = store.upsert_rows(customers, events, "c_custkey", ["ts", "event_id"])
    return merged.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(
    "update_rows",
    "select c_custkey, case when c_mktsegment = 'MACHINERY' then 0 else round(c_acctbal, 6) end as c_acctbal from customer",
)
def update_rows(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    changed = customers.where("c_mktsegment = 'MACHINERY'").withColumn("c_acctbal", F.lit(0.0))
    return store.update_rows(customers, changed, "c_custkey").select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("delete_rows", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def delete_rows(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey")
    return store.delete_rows(customers, table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")


@query("add_rows", "select c_custkey as id, c_name as name from customer union all select 1000000 + s_suppkey, s_name from supplier")
def add_rows(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").selectExpr("c_custkey as id", "c_name as name")
    suppliers = table(spark, folder, "supplier").selectExpr("1000000 + s_suppkey as id", "s_name as name")
    return store.add_rows(customers, suppliers, "id", ("name",))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as analysis runs: O pending, P running, F completed."""
    return table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey as string) as id",
        "cast(o_custkey as string) as repository_id",
        "case o_orderstatus when 'O' then 'pending' when 'P' then 'running' else 'completed' end as status",
        "if(o_orderstatus = 'O', null, cast(o_orderdate as timestamp)) as started_at",
        "if(o_orderstatus = 'F', cast(o_orderdate as timestamp) + interval 90 seconds, null) as completed_at",
        "cast(null as string) as error_message",
        "cast(o_orderdate as timestamp) as created_at",
        "cast(o_orderdate as timestamp) + interval 1500 milliseconds as updated_at",
    )


_STATUS = "case o_orderstatus when 'O' then 'pending' when 'P' then 'running' else 'completed' end"


def _transition_sql(sources: str, target: str, start: str, stop: str) -> str:
    return f"""select o_orderkey::varchar as id, {_STATUS} in ({sources}) as applied,
    case when {_STATUS} in ({sources}) then '{target}' else {_STATUS} end as status,
    (epoch_us({stop}) - epoch_us({start})) / 1000000 as duration_seconds from orders"""


_MOMENT = "timestamp '2030-01-01 00:00:00'"
_START = "case when o_orderstatus <> 'O' then o_orderdate end"
_STOP = "case when o_orderstatus = 'F' then o_orderdate + interval 90 seconds end"


def _register(name: str, action: str, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        moment = F.expr("timestamp '2030-01-01 00:00:00 UTC'")
        moved = records.attempt_transition(_runs(spark, folder), "run", action, moment, "stopped")
        return records.run_snapshots(moved).select("id", "applied", "status", "duration_seconds")


_register("run_start", "start", _transition_sql("'pending'", "running", f"case when o_orderstatus = 'O' then {_MOMENT} else o_orderdate end", _STOP))
_register("run_complete", "complete", _transition_sql("'running'", "completed", _START, f"case o_orderstatus when 'P' then {_MOMENT} when 'F' then o_orderdate + interval 90 seconds end"))
_register("run_fail", "fail", _transition_sql("'pending', 'running'", "failed", _START, f"case when o_orderstatus <> 'F' then {_MOMENT} else o_orderdate + interval 90 seconds end"))
_register("run_cancel", "cancel", _transition_sql("'pending', 'running'", "cancelled", _START, f"case when o_orderstatus <> 'F' then {_MOMENT} else o_orderdate + interval 90 seconds end"))


@query(
    "repository_fail",
    """select event_id as id, event_type in ('click', 'view') as applied,
    json_extract_string(props, '$.k')::bigint as k, case when event_type in ('click', 'view') then 'no space' end as failure_reason from events""",
)
def repository_fail(spark: SparkSession, folder: str) -> DataFrame:
    """Events as repositories: failing one adds the reason to its metadata."""
    repositories = table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.expr("case event_type when 'click' then 'pending' when 'view' then 'collecting' else 'ready' end").alias("status"),
        F.parse_json("props").alias("metadata"),
    )
    failed = records.attempt_transition(repositories, "repository", "mark_failed", reason="no space")
    return failed.select(
        "id",
        "applied",
        F.try_variant_get("metadata", "$.k", "bigint").alias("k"),
        F.try_variant_get("metadata", "$.failure_reason", "string").alias("failure_reason"),
    )


@query(
    "run_documents",
    f"""select o_orderkey::varchar as id, '{{"id":"' || o_orderkey || '","repository_id":"' || o_custkey || '","status":"' || {_STATUS}
    || '","started_at":' || coalesce('"' || strftime({_START}, '%Y-%m-%dT%H:%M:%S') || '+00:00"', 'null')
    || ',"completed_at":' || coalesce('"' || strftime({_STOP}, '%Y-%m-%dT%H:%M:%S') || '+00:00"', 'null')
    || ',"error_message":null,"created_at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00","updated_at":"'
    || strftime(o_orderdate + interval 1 second, '%Y-%m-%dT%H:%M:%S') || '.500000+00:00"}}' as document from orders""",
)
def run_documents(spark: SparkSession, folder: str) -> DataFrame:
    return records.to_documents(_runs(spark, folder), "analysis_runs")


@query(
    "run_round_trip",
    f"""select o_orderkey::varchar as id, {_STATUS} as status, (epoch_us({_STOP}) - epoch_us({_START})) / 1000000 as duration_seconds,
    epoch_us(o_orderdate + interval 1500 milliseconds) as updated_micros from orders""",
)
def run_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    decoded = records.from_documents(records.to_documents(_runs(spark, folder), "analysis_runs"), "analysis_runs")
    return records.run_snapshots(decoded).select(
        "id", "status", "duration_seconds", F.unix_micros("updated_at").alias("updated_micros")
    )


@query(
    "event_documents",
    """select event_id::varchar as id, '{"id":"' || event_id || '","analysis_run_id":"' || user_id || '","category":"' || event_type
    || '","message":"m","source_file_id":null,"severity":"info","score":null,"metadata":' || replace(props, ' ', '')
    || ',"created_at":"2026-01-01T12:00:00+00:00","updated_at":"2026-01-02T08:30:00+00:00"}' as document from events""",
)
def event_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Events as findings with open metadata."""
    findings = table(spark, folder, "events").selectExpr(
        "cast(event_id as string) as id",
        "cast(user_id as string) as analysis_run_id",
        "event_type as category",
        "'m' as message",
        "cast(null as string) as source_file_id",
        "'info' as severity",
        "cast(null as double) as score",
        "parse_json(props) as metadata",
        "timestamp '2026-01-01 12:00:00 UTC' as created_at",
        "timestamp '2026-01-02 08:30:00 UTC' as updated_at",
    )
    return records.to_documents(findings, "findings")


_GITHUB = (
    "case c_custkey % 5 when 0 then concat('https://github.com/own', c_nationkey, '/repo.', c_custkey, '.git') "
    "when 1 then concat('  git@github.com:own', c_nationkey, '/repo.', c_custkey, '//') "
    "when 2 then concat('own', c_nationkey, '/repo.', c_custkey) "
    "when 3 then concat('-own', c_nationkey, '/repo', c_custkey) else concat('https://gitlab.com/own', c_nationkey, '/r', c_custkey) end"
)


@query(
    "github_references",
    """select c_custkey, c_custkey % 5 < 3 as succeeded, case when c_custkey % 5 < 3 then 'repo.' || c_custkey end as name,
    case when c_custkey % 5 < 3 then 'https://github.com/own' || c_nationkey || '/repo.' || c_custkey || '.git' end as source_uri from customer""",
)
def github_references(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "customer").selectExpr("c_custkey", f"{_GITHUB} as source")
    return collect_hosted(sources, "github").select("c_custkey", "succeeded", "name", "source_uri")


_GITLAB = (
    "case c_custkey % 4 when 0 then concat('https://gitlab.com/g', c_nationkey, '/sub/r', c_custkey, '.git/') "
    "when 1 then concat('git@gitlab.com:g', c_nationkey, '/r', c_custkey) when 2 then concat('g', c_nationkey, '/a/b/r', c_custkey) "
    "else concat('lonely', c_custkey) end"
)


@query(
    "gitlab_references",
    """select c_custkey, c_custkey % 4 < 3 as succeeded, case when c_custkey % 4 < 3 then 'r' || c_custkey end as name,
    case c_custkey % 4 when 0 then 'https://gitlab.com/g' || c_nationkey || '/sub/r' || c_custkey || '.git'
    when 1 then 'https://gitlab.com/g' || c_nationkey || '/r' || c_custkey || '.git'
    when 2 then 'https://gitlab.com/g' || c_nationkey || '/a/b/r' || c_custkey || '.git' end as source_uri from customer""",
)
def gitlab_references(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "customer").selectExpr("c_custkey", f"{_GITLAB} as source")
    return collect_hosted(sources, "gitlab").select("c_custkey", "succeeded", "name", "source_uri")


@query(
    "keyed_changes",
    """with c as (select c_custkey as id, c_name as name, c_nationkey::bigint as n, c_custkey % 3 <> 0 as early, c_custkey % 7 = 0 as seventh
      from customer)
    select id, name, case when seventh then -n when early and id % 5 = 1 then n + 100 else n end as n from c
    where not ((early or seventh) and id % 11 = 3)""",
)
def keyed_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Customers through every kind of change of a keyed table: add, update, upsert, delete, compact, add again."""
    rows = table(spark, folder, "customer").selectExpr("c_custkey as id", "c_name as name", "cast(c_nationkey as bigint) as n")
    made = create_keyed(spark, f"{checkpoint_folder(spark)}/keyed-{uuid.uuid4().hex}", rows.schema, "id", ("name",), buckets=8)
    made.add(rows.where("id % 3 <> 0"))
    made.update(rows.where("id % 3 <> 0 and id % 5 = 1").withColumn("n", F.col("n") + 100))
    made.upsert(rows.where("id % 7 = 0").withColumn("n", -F.col("n")))
    made.delete(rows.where("id % 11 = 3").select("id"))
    made.compact()
    made.add(rows.where("id % 3 = 0 and id % 7 <> 0"))
    return made.rows()
