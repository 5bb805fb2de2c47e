"""Vector search, memory queries, keyed tables, entity records, transitions and checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.errors import DimensionMismatchError, IntegrityError, NotFoundError, ValidationError
from siltstone.operators import checks, records, search, store
from siltstone.sources import collections

VECTORS = [("a", [1.0, 0.0, 0.0], "x"), ("b", [0.0, 1.0, 0.0], "y"), ("c", [-1.0, 0.0, 0.0], "x"), ("d", [2.0, 0.0, 0.0], "y")]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "id string, embedding array<double>, lang string")


def found(frame):
    return [(row.id, round(row.score, 9)) for row in frame.collect()]


def test_search_scores_order_limit_and_filter(vectors):
    query = [1.0, 0.0, 0.0]
    assert found(search.search(vectors, query)) == [("a", 1.0), ("d", 1.0), ("b", 0.5), ("c", 0.0)]
    assert found(search.search(vectors, query, 1)) == [("a", 1.0)]
    assert found(search.search(vectors, query, condition=F.col("lang") == "y")) == [("d", 1.0), ("b", 0.5)]
    assert found(search.search(vectors.limit(0), query)) == []


def test_search_is_a_top_k_without_a_full_sort(vectors):
    plan = search.search(vectors, [1.0, 0.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_search_leaves_out_vectors_without_direction(spark):
    frame = spark.createDataFrame([("z", [0.0, 0.0])], "id string, embedding array<double>")
    assert found(search.search(frame, [1.0, 0.0])) == []


@pytest.mark.parametrize(("query", "limit"), [([], 1), ([float("nan")], 1), ([1.0], 0)])
def test_bad_search_requests(vectors, query, limit):
    with pytest.raises(ValidationError):
        search.search(vectors, query, limit)


def test_dimension_checks(vectors):
    with pytest.raises(DimensionMismatchError):
        search.search(vectors, [1.0], dimensions=3)
    with pytest.raises(DimensionMismatchError):
        search.require_dimensions(vectors, 2)
    with pytest.raises(Exception, match="embedding without 2 dimensions: 3"):
        search.search(vectors, [1.0, 0.0]).collect()


def test_memory_query(spark):
    rows = [
        ("3", "note", "e1", '{"k": 1, "t": "x"}'),
        ("1", "note", "e2", '{"k": 1.0}'),
        ("2", "fact", "e1", '{"k": "1", "n": null}'),
        ("4", "note", "e1", '{"k": true}'),
    ]
    memory = spark.createDataFrame(rows, "id string, memory_type string, entity_id string, m string").withColumn(
        "metadata", F.parse_json("m")
    )

    def ids(**wanted):
        return [row.id for row in search.memory_query(memory, **wanted).collect()]

    assert ids() == ["1", "2", "3", "4"]
    assert ids(memory_type="note", limit=2) == ["1", "3"]
    assert ids(entity_id="e1", memory_type="note") == ["3", "4"]
    assert ids(metadata_filter={"k": 1}) == ["1", "3", "4"]
    assert ids(metadata_filter={"k": "1"}) == ["2"]
    assert ids(metadata_filter={"k": 1, "t": "x"}) == ["3"]
    assert ids(metadata_filter={"n": None}) == ["1", "2", "3", "4"]
    assert ids(metadata_filter={"k": None}) == []
    for wanted in ({"limit": 0}, {"memory_type": " "}):
        with pytest.raises(ValidationError):
            search.memory_query(memory, **wanted)


def test_keyed_table_changes(spark):
    table = spark.createDataFrame([("1", "u1", 1), ("2", "u2", 2)], "id string, uri string, v int")

    def rows(*values):
        return spark.createDataFrame(list(values), table.schema)

    def contents(frame):
        return sorted(map(tuple, frame.collect()))

    assert contents(store.add_rows(table, rows(("3", "u3", 3)), "id", ("uri",)))[-1] == ("3", "u3", 3)
    for clash in (rows(("1", "u9", 0)), rows(("9", "u1", 0)), rows(("7", "a", 0), ("7", "b", 0))):
        with pytest.raises(IntegrityError):
            store.add_rows(table, clash, "id", ("uri",))
    assert contents(store.update_rows(table, rows(("2", "u2", 9)), "id")) == [("1", "u1", 1), ("2", "u2", 9)]
    with pytest.raises(NotFoundError):
        store.update_rows(table, rows(("9", "x", 0)), "id")
    assert contents(store.delete_rows(table, rows(("9", "x", 0)), "id")) == contents(table)
    assert contents(store.upsert_rows(table, rows(("2", "a", 5), ("2", "b", 7), ("4", "c", 1)), "id", ["v"])) == [
        ("1", "u1", 1),
        ("2", "b", 7),
        ("4", "c", 1),
    ]
    assert store.exists(table, "id", "1") and not store.exists(table, "id", "9")
    assert store.list_by(table, "uri", "u2").count() == 1
    status = spark.createDataFrame([("UPDATE 3",)], "s string")
    assert status.select(store.affected_rows("s")).first()[0] == 3


def test_generations(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = spark.createDataFrame([], "id string, v int").schema
    assert store.load_latest(spark, path, schema).count() == 0
    first = spark.createDataFrame([("1", 1)], schema)
    assert store.save_generation(first, path) == 1
    changed = store.upsert_rows(store.load_latest(spark, path, schema), spark.createDataFrame([("1", 2)], schema), "id", ["v"])
    assert store.save_generation(changed, path) == 2
    (tmp_path / "table" / "generation=3").mkdir()  # a write that never finished
    assert [tuple(row) for row in store.load_latest(spark, path, schema).collect()] == [("1", 2)]
    broken = changed.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.save_generation(broken, path)
    assert [tuple(row) for row in store.load_latest(spark, path, schema).collect()] == [("1", 2)]
    assert store.save_generation(changed, path) == 5  # past generation 3, never finished, and 4, which failed


def entities(spark):
    return spark.createDataFrame(
        [("11111111-1111-1111-1111-111111111111", "n", "uri", "github", "develop", "collecting", '{"stars":42,"nested":{"a":1}}')],
        "id string, name string, source_uri string, provider string, default_branch string, status string, m string",
    ).select(
        "id", "name", "source_uri", "provider", "default_branch", "status",
        F.parse_json("m").alias("metadata"),
        F.expr("timestamp '2026-01-01 12:00:00 UTC'").alias("created_at"),
        F.expr("timestamp '2026-01-02 08:30:00.25 UTC'").alias("updated_at"),
    )


def test_records_round_trip(spark, tmp_path):
    original = entities(spark)
    text = records.to_documents(original, "repositories").first().document
    assert '"created_at":"2026-01-01T12:00:00+00:00","updated_at":"2026-01-02T08:30:00.250000+00:00"' in text
    collections.write_json(original, str(tmp_path / "json"), "repositories")
    decoded = collections.read_json(spark, str(tmp_path / "json"), "repositories")
    columns = [F.col(c).cast("string") for c in original.columns if c != "metadata"] + [F.to_json("metadata")]
    assert decoded.select(*columns).collect() == original.select(*columns).collect()


def test_json_map_collection(spark, tmp_path):
    document = records.to_documents(entities(spark), "repositories").first().document
    path = tmp_path / "source_repositories.json"
    assert collections.read_json_map(spark, str(path), "repositories").count() == 0
    path.write_text(" \n")
    assert collections.read_json_map(spark, str(path), "repositories").count() == 0
    path.write_text('{"11111111-1111-1111-1111-111111111111": ' + document + "}")
    (row,) = collections.read_json_map(spark, str(path), "repositories").collect()
    assert (row.name, row.status, row.created_at.year) == ("n", "collecting", 2026)
    path.write_text("[1]")
    with pytest.raises(Exception, match="expected a JSON object"):
        collections.read_json_map(spark, str(path), "repositories").collect()


def test_jdbc_options():
    options = collections.jdbc_options("jdbc:x", "findings", "id", ("0", "9"), 4)
    assert options["numPartitions"] == "4" and options["partitionColumn"] == "id"
    assert collections.jdbc_options("jdbc:x", "findings") == {"url": "jdbc:x", "dbtable": "findings"}


def test_transitions(spark):
    repository = entities(spark)
    ready = records.transition(repository, "repository", "mark_ready").first()
    assert ready.status == "ready" and ready.updated_at > repository.first().updated_at
    with pytest.raises(Exception, match="cannot mark_collecting"):
        records.transition(repository, "repository", "mark_collecting").collect()
    failed = records.transition(repository, "repository", "mark_failed", reason="why").select(
        "status", F.to_json("metadata").alias("m")
    )
    assert failed.first().m == '{"failure_reason":"why","nested":{"a":1},"stars":42}' and failed.first().status == "failed"
    with pytest.raises(ValidationError):
        records.transition(repository, "repository", "nope")


def test_checks(spark):
    bad = spark.createDataFrame([(" ", "u"), ("n", "u")], "name string, source_uri string").withColumn("id", F.lit("1"))
    broken = {(row.rule, row.violations) for row in checks.violations(bad, "repositories").collect()}
    assert ("name filled", 1) in broken and ("unique id", 1) in broken and ("source_uri filled", 0) in broken
    with pytest.raises(IntegrityError):
        checks.require_valid(bad, "repositories")
    with pytest.raises(ValidationError):
        checks.require_valid(spark.createDataFrame([(-1,)], "test_function_count int").withColumn("test_class_count", F.lit(0)), "test_evidence")


def test_every_rule_is_valid_sql(spark):
    for relation, rules in checks.RULES.items():
        for rule, condition in rules.items():
            spark._jsparkSession.sessionState().sqlParser().parseExpression(condition), (relation, rule)


def test_lookups_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([("1", "r", 1), ("2", "r", 2)], "id string, repository_id string, v int").write.parquet(path)
    table = spark.read.parquet(path)
    plan = store.list_by(table, "repository_id", "r").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(repository_id,r)" in plan and "v#" not in plan


def test_iso_text_is_utc_in_any_session_zone(spark):
    moment = spark.range(1).select(F.expr("timestamp '2026-01-01 12:00:00 UTC'").alias("m"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert moment.select(records.iso_text(F.col("m"))).first()[0] == "2026-01-01T12:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
