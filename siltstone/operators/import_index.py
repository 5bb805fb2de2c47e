"""A stored index of resolved imports, which a change of files brings up to date without resolving everything again.

Three keyed tables in a shared folder hold the files, the resolved edges of every source file (one row a file, so the imports
of one file are in one bucket), and which sources depend on which lookup. A lookup is a path that an import asks for in
one way (as a module, a package, a script or an include). The lookups that can name a file follow from its name, so a file that
comes or goes leads to the few lookups that may now have another answer, and from there to the sources that hold them.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import AbstractContextManager, ExitStack
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions import paths
from siltstone.operators.dependencies import edge_order, lookups_naming, request_lookups, resolve_requests, with_request
from siltstone.operators.keyed import KeyedTable, Staged, create_keyed
from siltstone.session import drop_shuffles, hash_joins, sorted_groups, written_copies

_MARK = "\u001f"  # between a scope and what lies in it
_EDGE = (
    "array<struct<line_number: bigint, target_module: string, imported_names: array<string>, alias: string, "
    "named_internal: boolean, target: string, target_kind: string>>"
)

# An edge as given, and what it led to where it comes from the table.
_RAW = [
    *["scope", "relative_path", "target_module", "imported_names", "alias", "is_internal", "line_number"],
    *["was_target", "was_kind"],
]


def _parts(pair: Column) -> tuple[Column, Column]:
    """The lookup and the source of a pair, which is the lookup's length, a colon, the lookup and the source."""
    at, length = F.instr(pair, ":"), F.substring_index(pair, ":", 1).cast("int")
    return F.substr(pair, at + 1, length), F.substr(pair, at + length + 1)


class HolderTable(KeyedTable):
    """Pairs of a lookup and a source that holds it, in buckets of the lookup; the key spells both and is all that is stored."""

    def _bucket(self, key: Column) -> Column:
        return super()._bucket(_parts(key)[0])

    def _require(self, rows: DataFrame, base: int, known: bool | None, removed: DataFrame | None = None) -> None:
        """Pairs are filled and distinct when they come here, and one that is known already may come again."""

    def holding(self, lookups: DataFrame, version: int) -> DataFrame:
        """The pairs of these lookups; only their buckets are read."""
        bucket = super()._bucket(F.col("lookup"))
        buckets = [row[0] for row in lookups.select(bucket).distinct().collect()]  # at most one a bucket
        (lookup, source), hashed = _parts(F.col("pair")), F.xxhash64("lookup").alias("_hash")
        held = self.rows(version, buckets).select(lookup.alias("lookup"), source.alias("id"))
        return held.select("*", hashed).join(lookups.select(hashed, "lookup"), ["_hash", "lookup"], "left_semi").drop("_hash")


class ImportIndex:
    """The index in one folder; ``scope`` names the column that tells repositories apart, if there is more than one."""

    def __init__(self, spark: SparkSession, path: str, scope: str | None = None, buckets: int = 64):
        self.scope = scope

        def made(name: str, schema: str, key: str) -> str:
            create_keyed(spark, f"{path}/{name}", StructType.fromDDL(schema), key, buckets=buckets)
            return f"{path}/{name}"

        file = "id string, scope string, file_key string, relative_path string"
        self.files = KeyedTable(spark, made("files", file, "id"))
        self.sources = KeyedTable(spark, made("sources", f"id string, scope string, source string, edges {_EDGE}", "id"))
        self.holders = HolderTable(spark, made("holders", "pair string", "pair"))

    # Reading

    def _relations(self, rows: DataFrame) -> DataFrame:
        each = rows.select("scope", "source", F.inline("edges"))
        kept = [] if self.scope is None else [F.col("scope").alias(self.scope)]
        internal = (F.col("target_kind") != "external_module").alias("is_internal")
        return each.select(
            *kept, "source", "target", "target_kind", internal, "imported_names", "alias", "line_number"
        )

    def edges(self) -> DataFrame:
        """All relation edges, as ``resolve_imports`` gives them."""
        return self._relations(self.sources.rows())

    def outgoing(self, identifier: str, scope: str = "") -> DataFrame:
        """The relation edges of one file in edge order; one bucket is read. No rows for an unknown file."""
        return self._relations(self.sources.get(f"{scope}{_MARK}{identifier}")).orderBy(*edge_order())

    # Writing

    def _scoped(self, frame: DataFrame) -> DataFrame:
        scope = F.lit("") if self.scope is None else F.coalesce(F.col(self.scope).cast("string"), F.lit(""))
        return frame.withColumn("scope", scope)

    def _files(self, frame: DataFrame) -> DataFrame:
        named = self._scoped(frame).select("scope", paths.normalize("relative_path").alias("file_key"), "relative_path")
        named = named.select(F.concat("scope", F.lit(_MARK), "file_key").alias("id"), *named.columns)
        return self.files.deal(named, F.col("id")).distinct().drop("_bucket", "_share")

    def _pairs(self, wanted: DataFrame) -> DataFrame:
        """Pairs of a lookup and its source, of edges with their requests, once each."""
        lookup, source = (F.concat("scope", F.lit(_MARK), name) for name in ("lookup", "relative_path"))
        pair = F.concat(F.length(lookup).cast("string"), F.lit(":"), lookup, source)
        pairs = request_lookups(wanted, "scope").select(pair.alias("pair"))
        return self.holders.deal(pairs, F.col("pair")).distinct().drop("_bucket", "_share")

    def _raw(self, rows: DataFrame) -> DataFrame:
        """Stored edges in the form they were given in."""
        each = rows.select("scope", F.col("source").alias("relative_path"), F.inline("edges"))
        names = {"named_internal": "is_internal", "target": "was_target", "target_kind": "was_kind"}
        return each.withColumnsRenamed(names).select(*_RAW)

    def _grouped(self, resolved: DataFrame, changed: DataFrame) -> DataFrame:
        """One row a source: the changed files, and sources out of the table of which an edge has another answer now.

        Files are mentions beside the edges, and an edge carries its former answer, so nothing is joined to the groups.
        """
        edge = F.struct(
            "line_number", "target_module", "imported_names", "alias", "named_internal", "target", "target_kind"
        )
        same = F.col("target").eqNullSafe(F.col("was_target")) & F.col("target_kind").eqNullSafe(F.col("was_kind"))
        each = resolved.select(
            "scope",
            "source",
            edge.alias("edge"),
            F.lit(False).alias("listed"),
            F.col("was_kind").isNotNull().alias("stored"),
            (~same).alias("moved"),
        )
        no, nothing = F.lit(False), F.lit(None).cast(each.schema["edge"].dataType)
        listed = changed.select(
            "scope",
            F.col("relative_path").alias("source"),
            nothing.alias("edge"),
            F.lit(True).alias("listed"),
            no.alias("stored"),
            no.alias("moved"),
        )
        identifier = F.concat("scope", F.lit(_MARK), "source")
        dealt = self.sources.deal(each.unionByName(listed), identifier).withColumn("_hash", F.xxhash64("scope", "source"))
        flags = [F.max(name).alias(name) for name in ("listed", "stored", "moved")]
        keys = ["_hash", "_bucket", "_share", "scope", "source"]
        grouped = dealt.sortWithinPartitions(*keys).groupBy(*keys).agg(
            F.sort_array(F.collect_list("edge")).alias("edges"), *flags
        )
        return grouped.where("listed or (stored and moved)").select(identifier.alias("id"), "scope", "source", "edges")

    def apply(self, files: DataFrame, edges: DataFrame, removed: DataFrame | None = None) -> None:
        """Take in new and changed ``files`` with all their import ``edges``, and forget ``removed`` ones.

        Sources of unchanged files are resolved again only if they hold a lookup that can name a file that came or went, and
        are written only if an edge of theirs changed. The commit of the file table is the last that matters: a change that
        failed before it is run again as a whole, with the same result. Another writer's change raises ConflictError.
        What a step leaves for the next is written as Parquet and goes when the change is done, as do its shuffles; rows of the
        tables are written in their place and joined to a version afterwards.
        """
        spark = self.files.spark
        settings = drop_shuffles(spark), hash_joins(spark), sorted_groups(spark)
        with ExitStack() as staged:
            for setting in settings:
                staged.enter_context(setting)
            written = staged.enter_context(written_copies(spark))
            self._apply(files, edges, removed, written, staged.enter_context)

    def _apply(
        self,
        files: DataFrame,
        edges: DataFrame,
        removed: DataFrame | None,
        written: Callable[[DataFrame], DataFrame],
        hold: Callable[[AbstractContextManager[Staged]], Staged],
    ) -> None:
        at_files, at_sources = self.files.version(), self.sources.version()
        at_holders = self.holders.version()
        new_files, known = hold(self.files.staged(self._files(files), at_files, dealt=True)), self.files.rows(at_files)
        changed = new_files.rows
        leaving = changed.limit(0)
        if removed is not None:
            leaving = written(self._files(removed).join(changed.select("id"), "id", "left_anti"))
        created = changed
        if at_files:  # the few known ones among the changed are found first
            held = known.select("id").join(changed.select("id"), "id", "left_semi")
            created = written(changed.join(held, "id", "left_anti"))
        gone = leaving.join(known.select("id"), "id", "left_semi")
        stored, source = self.sources.rows(at_sources), ["scope", "source"]
        waiting = before = stored.limit(0)
        known_again = False
        if at_sources:
            own = changed.unionByName(leaving).select("scope", F.col("relative_path").alias("source")).distinct()
            again = written(stored.select(*source).join(own, source, "left_semi"))
            known_again = not again.isEmpty()
            if known_again:
                before = written(stored.join(again, source, "left_semi"))
        if at_holders:  # an index without pairs has no source to resolve again
            names = created.unionByName(gone).select("scope", F.explode(lookups_naming(F.col("file_key"))).alias("name"))
            names = written(names.select(F.concat("scope", F.lit(_MARK), "name").alias("lookup")).distinct())
            hashed = F.xxhash64("id").alias("_hash")
            touched = self.holders.holding(names, at_holders).select(hashed, "id").distinct()
            waiting = stored.select("*", hashed).join(touched, ["_hash", "id"], "left_semi").drop("_hash")
            waiting = waiting.join(before.select(*source), source, "left_anti")
        left = leaving.select("scope", F.col("relative_path").alias("source"))
        forgotten = before.join(left, source, "left_semi")

        nothing = F.lit(None).cast("string")
        given = self._scoped(edges).withColumns(
            {"line_number": F.col("line_number").cast("bigint"), "was_target": nothing, "was_kind": nothing}
        )
        work = given.select(*_RAW).unionByName(self._raw(waiting)).withColumn("named_internal", F.col("is_internal"))
        asked = written(with_request(work, "scope"))
        now = known.join(leaving.select("id"), "id", "left_anti").unionByName(created)
        carried = ("target_module", "named_internal", "was_target", "was_kind")
        resolved = resolve_requests(asked, now.select("scope", "relative_path"), "scope", carried=carried)
        fresh = self._grouped(resolved, changed)
        if known_again:
            was = before.select(*source, F.col("edges").alias("was"))
            fresh = fresh.join(was, source, "left").where(~F.col("edges").eqNullSafe(F.col("was"))).drop("was")
        fresh = hold(self.sources.staged(fresh, at_sources, dealt=not known_again))

        # A pair too many does no harm, so pairs come first and stale ones go last.
        pairs = hold(self.holders.staged(self._pairs(asked.where("was_kind is null")), self.holders.version(), dealt=True))
        stale = pairs.rows.limit(0)
        if known_again:
            lost = self._pairs(with_request(self._raw(before), "scope"))
            stale = written(lost.join(pairs.rows, "pair", "left_anti"))
        if not pairs.rows.isEmpty():
            self.holders.upsert_staged(pairs)
        steps = [
            (fresh.rows.isEmpty(), lambda base: self.sources.upsert_staged(fresh)),
            (forgotten.isEmpty(), lambda base: self.sources.delete(forgotten.select("id"), base=base)),
        ]
        reduce(lambda base, step: base if step[0] else step[1](base), steps, at_sources)
        steps = [
            (changed.isEmpty(), lambda base: self.files.upsert_staged(new_files)),
            (leaving.isEmpty(), lambda base: self.files.delete(leaving.select("id"), base=base)),
        ]
        reduce(lambda base, step: base if step[0] else step[1](base), steps, at_files)
        if not stale.isEmpty():
            self.holders.delete(stale)
