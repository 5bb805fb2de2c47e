"""Reuse candidates: subjects, comparison, ranking, selection, merge and export.

Conflicts only arise between subjects of one (kind, name), and inside such a group they follow from the
signals alone. The operators therefore work on groups and group leaders; no pair list is ever built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siltstone.errors import IntegrityError, ValidationError
from siltstone.functions.documents import canonical_json, export_checksum
from siltstone.functions.paths import qualified_name
from siltstone.operators.checks import duplicates, missing, require_empty, require_found
from siltstone.operators.components import greedy_choice
from siltstone.operators.spread import HOT_ROWS, distributed_rank, order_statistic, spread_join
from siltstone.session import cut_lineage, write_copy

# Fixed value: version written into exports.
FORMAT_VERSION = "1.0"


class SelectionPolicy(NamedTuple):
    minimum_score: float = 0.0
    maximum_selected: int | None = None
    required_kind: str | None = None

    def checked(self) -> "SelectionPolicy":
        if not 0.0 <= self.minimum_score <= 1.0:
            raise ValidationError("minimum_score must be between 0.0 and 1.0")
        if self.maximum_selected is not None and self.maximum_selected <= 0:
            raise ValidationError("maximum_selected must be positive when set")
        return self


def build_subjects(candidates: DataFrame) -> DataFrame:
    """Candidates with their id ``repository:path::name``; needs ``repository_id``."""
    name = qualified_name("relative_path", "name")
    return candidates.withColumn("subject_id", F.concat(F.col("repository_id").cast("string"), F.lit(":"), name))


def require_unique_subjects(subjects: DataFrame) -> DataFrame:
    require_empty(duplicates(subjects, ["subject_id"]), "two candidates share a subject id", IntegrityError)
    return subjects


def verdict(left: str, right: str) -> Column:
    """Verdict for two subject structs (kind, name, signals)."""
    same_kind = F.col(f"{left}.kind") == F.col(f"{right}.kind")
    same_name = F.col(f"{left}.name") == F.col(f"{right}.name")
    signals = F.col(f"{left}.signals"), F.col(f"{right}.signals")
    return (
        F.when(same_kind & same_name & (signals[0] == signals[1]), "equivalent")
        .when(same_kind & same_name, "conflicting")
        .when(same_kind & F.arrays_overlap(*signals), "compatible")
        .otherwise("distinct")
    )


def shared_signals(left: str, right: str) -> Column:
    return F.array_sort(F.array_intersect(F.col(f"{left}.signals"), F.col(f"{right}.signals")))


def compare_pairs(pairs: DataFrame, subjects: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Verdict and shared signals of the given (left_subject_id, right_subject_id) pairs.

    The pairs come from the caller and are computed once; a subject that occurs in very many of them is split over tasks.
    """
    ids = ["left_subject_id", "right_subject_id"]
    written = joined = cut_lineage(pairs.select(*ids))
    require_empty(written.where("left_subject_id = right_subject_id"), "cannot compare a subject to itself")
    for side, id_column in zip(("left", "right"), ids):
        described = subjects.select(F.col("subject_id").alias(id_column), F.struct("kind", "name", "signals").alias(side))
        counts = written.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.count("*").alias("rows"))
        joined = spread_join(joined, described, [id_column], ids, counts, hot_rows)
    return joined.select(*ids, verdict("left", "right").alias("verdict"), shared_signals("left", "right").alias("shared_signals"))


def group_leaders(subjects: DataFrame, eligible: Column | None = None) -> DataFrame:
    """Best eligible subject of each (kind, name) by (-score, subject_id), with its signals and the group size."""
    place = F.struct((-F.col("score")).alias("rank_key"), "subject_id", "signals")
    best = F.min(place if eligible is None else F.when(eligible, place)).alias("b")
    return subjects.groupBy("kind", "name").agg(best, F.count("*").alias("rows")).select(
        "kind",
        "name",
        F.col("b.subject_id").alias("leader_id"),
        F.col("b.signals").alias("leader_signals"),
        (-F.col("b.rank_key")).alias("leader_score"),
        "rows",
    )


def compare_to_leaders(subjects: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every subject against the best of its (kind, name) group: the comparisons a selection depends on."""
    leaders = group_leaders(subjects)
    joined = spread_join(
        subjects, leaders, ["kind", "name"], ["subject_id"], leaders.select("kind", "name", "rows"), hot_rows
    )
    return joined.where("subject_id <> leader_id").select(
        F.col("leader_id").alias("left_subject_id"),
        F.col("subject_id").alias("right_subject_id"),
        F.when(F.col("signals") == F.col("leader_signals"), "equivalent").otherwise("conflicting").alias("verdict"),
        F.array_sort(F.array_intersect("signals", "leader_signals")).alias("shared_signals"),
    )


_BIG = "decimal(38,0)"


def _pairs(count: Column) -> Column:
    count = count.cast("decimal(18,0)")
    return (count * (count - 1) / 2).cast(_BIG)


def _overlapping_pairs(classes: DataFrame) -> DataFrame:
    """One row: ``pairs`` of subjects of one kind whose different signal sets share a signal, names not counted twice.

    Pairs are counted by inclusion and exclusion over the signal subsets T that at least two distinct sets hold, level by
    level; a pair of sets with a common signal is counted once in sum. Where all holders of T have a further signal x
    beyond T's last, the subsets that extend T come in twos, with and without x, of equal count and opposite sign. So T
    and all that extends it add up to nothing and are left out; sets that differ little are settled in the first level.
    """
    held = classes.where("size(_set) > 0").select("kind", "name", "_set", "n", F.array().cast("array<string>").alias("subset"))
    keys, total, sign = ["kind", "subset"], None, 1
    no_count, nothing = F.lit(0).cast("bigint"), F.lit(0).cast(_BIG)
    while True:
        # Occurrences of the subsets one signal longer: every later signal of a holder extends its subset.
        later = F.expr("filter(_set, x -> size(subset) = 0 or x > try_element_at(subset, -1))")
        longer = held.select("kind", "name", "_set", "n", "subset", F.explode(later).alias("x")).withColumn(
            "subset", F.array_append("subset", F.col("x"))
        )
        sets = longer.groupBy(*keys, "_set").agg(
            F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("same_name")
        )
        shared = sets.groupBy(*keys).agg(
            F.count("*").alias("sets"),
            F.sum("n").alias("n"),
            F.sum(_pairs(F.col("n")) - F.col("same_name")).alias("within"),
        ).where("sets > 1")
        further = (
            sets.select(*keys, F.explode(F.expr("filter(_set, x -> x > try_element_at(subset, -1))")).alias("x"))
            .groupBy(*keys, "x")
            .agg(F.count("*").alias("holders"))
            .groupBy(*keys)
            .agg(F.max("holders").alias("most"))
        )
        kept = cut_lineage(
            shared.join(further, keys, "left").where("most is null or most < sets").select(*keys, "n", "within")
        )
        held = cut_lineage(longer.drop("x").join(kept.select(*keys), keys, "left_semi"))
        names = held.groupBy(*keys, "name").agg(F.sum("n").alias("n"))
        further_on = F.expr("try_element_at(_set, -1) > try_element_at(subset, -1)")
        counted = (
            kept.select("n", "within", nothing.alias("same"), F.lit(False).alias("more"))
            .unionByName(names.select(no_count.alias("n"), nothing.alias("within"), _pairs(F.col("n")).alias("same"), F.lit(False).alias("more")))
            .unionByName(held.select(no_count.alias("n"), nothing.alias("within"), nothing.alias("same"), further_on.alias("more")))
        )
        level = counted.agg(
            F.coalesce(F.sum(_pairs(F.col("n")) - F.col("within") - F.col("same")), F.lit(0)).alias("pairs"),
            F.coalesce(F.bool_or("more"), F.lit(False)).alias("more"),
        ).first()  # one row
        total = sign * level["pairs"] + (total or 0)
        if not level["more"]:
            break
        sign = -sign
    return classes.sparkSession.createDataFrame([(total,)], f"pairs {_BIG}")


def verdict_counts(subjects: DataFrame) -> DataFrame:
    """How many unordered pairs of all subjects get each verdict, without listing the pairs.

    Equal subjects collapse into classes with a size. Pairs of one signal set follow from the class sizes; pairs of
    different sets that share a signal are counted over a lattice of subsets, for sets of any size. Counts are decimals,
    as the pairs of billions of subjects exceed 64 bits.
    """
    classes = cut_lineage(
        subjects.withColumn("_set", F.array_sort(F.array_distinct(F.array_compact("signals"))))
        .groupBy("kind", "name", "signals", "_set")
        .agg(F.count("*").alias("n"))
    )
    names = classes.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("equal"))
    total = names.agg(
        _pairs(F.sum("n")).alias("every"), F.sum(_pairs(F.col("n"))).alias("same_name"), F.sum("equal").alias("equivalent")
    )
    by_set = classes.groupBy("kind", "name", "_set").agg(F.sum("n").alias("n"))
    same_set = (
        by_set.where("size(_set) > 0")
        .groupBy("kind", "_set")
        .agg((_pairs(F.sum("n")) - F.sum(_pairs(F.col("n")))).alias("pairs"))
        .agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("same_set"))
    )
    different = _overlapping_pairs(by_set).withColumnRenamed("pairs", "different")
    # One row each.
    return total.join(same_set, F.lit(True)).join(different, F.lit(True)).selectExpr(
        "stack(4, 'equivalent', equivalent, 'conflicting', same_name - equivalent, 'compatible', same_set + different, "
        "'distinct', every - same_name - same_set - different) as (verdict, pairs)"
    ).select("verdict", F.coalesce(F.col("pairs"), F.lit(0)).cast(_BIG).alias("pairs"))


def default_score(public: float = 0.5, documented: float = 0.3, signalled: float = 0.2, full: int = 5) -> Column:
    """Weighted share of visibility, documentation and signals, in 0..1."""
    return (
        F.when(F.col("is_public"), F.lit(public)).otherwise(F.lit(0.0))
        + F.when(F.col("has_docstring"), F.lit(documented)).otherwise(F.lit(0.0))
        + F.least(F.size("signals"), F.lit(full)) / F.lit(float(full)) * signalled
    )


def score_subjects(subjects: DataFrame, score: Column | None = None) -> DataFrame:
    return subjects.withColumn("score", default_score() if score is None else score)


def rank_order() -> list[Column]:
    return [F.desc("score"), F.asc("subject_id")]


def rank_subjects(scored: DataFrame) -> DataFrame:
    """Position of every subject by (-score, subject_id)."""
    return distributed_rank(scored, rank_order())


def _up_to(threshold: Row, score: Column, subject_id: Column) -> Column:
    """Whether a subject stands at or before the threshold in rank order."""
    limit = F.lit(threshold["score"])
    return (score > limit) | ((score == limit) & (subject_id <= F.lit(threshold["subject_id"])))


def top(scored: DataFrame, count: int) -> DataFrame:
    """The first ``count`` subjects in rank order: all up to the one of that rank, which ranges of counts locate."""
    if count < 0:
        raise ValidationError("count must not be negative")
    if count == 0:
        return scored.limit(0)
    last = order_statistic(scored.select("score", "subject_id"), rank_order(), count)
    kept = scored if last is None else scored.where(_up_to(last, F.col("score"), F.col("subject_id")))
    return kept.orderBy(*rank_order())


def score_for(scored: DataFrame, subject_id: str) -> DataFrame:
    return require_found(scored.where(F.col("subject_id") == subject_id), f"no score for '{subject_id}'")


def require_consistent(subjects: DataFrame, scored: DataFrame, comparisons: DataFrame | None = None) -> None:
    """Scores and comparisons may only mention known subjects."""
    require_empty(missing(scored, "subject_id", subjects, "subject_id"), "a score names an unknown subject")
    for side in ("left_subject_id", "right_subject_id") if comparisons is not None else ():
        require_empty(missing(comparisons, side, subjects, "subject_id"), "a comparison names an unknown subject")


def _outcome(reason: Column) -> list[Column]:
    message = F.when(reason == "below_minimum_score", "score is below the minimum").when(
        reason == "kind_mismatch", "kind is not the required one"
    ).when(reason == "conflicting_with_selected", "conflicts with a selected subject").when(
        reason == "capacity_exceeded", "the selection is full"
    )
    return [reason.isNull().alias("selected"), reason.alias("reason"), message.alias("message")]


def _eligibility(policy: SelectionPolicy) -> Column:
    kind = F.lit(False) if policy.required_kind is None else F.col("kind") != policy.required_kind
    return F.when(F.col("score") < policy.minimum_score, "below_minimum_score").when(kind, "kind_mismatch")


def _capacity_end(free: DataFrame, policy: SelectionPolicy) -> Row | None:
    """Score and id of the last conflict-free subject within the capacity; None when all fit."""
    if policy.maximum_selected is None:
        return None
    return order_statistic(free.select("score", "subject_id"), rank_order(), policy.maximum_selected)


def select_subjects(scored: DataFrame, policy: SelectionPolicy, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Greedy selection in rank order, every subject selected or rejected with a reason.

    Walking a (kind, name) group in rank order, its leader is taken first, and from then on exactly the
    subjects with the leader's signals are free of conflict. So one minimum per group replaces the walk. Of the free
    subjects the first ``maximum_selected`` fit: those up to one place in rank order, which is found from
    counts of ranges. A leader is the first free subject of its group, so whether it was selected follows from its place too.
    """
    policy = policy.checked()
    judged = scored.withColumn("_reason", _eligibility(policy))
    leaders = group_leaders(judged, F.col("_reason").isNull())
    joined = spread_join(
        judged,
        leaders,
        ["kind", "name"],
        ["subject_id"],
        leaders.select("kind", "name", "rows"),
        hot_rows,
    )
    end = None
    if policy.maximum_selected is not None:
        joined = cut_lineage(joined)
        end = _capacity_end(joined.where("_reason is null and signals = leader_signals"), policy)
    always = F.lit(True)
    fits = always if end is None else _up_to(end, F.col("score"), F.col("subject_id"))
    led = always if end is None else _up_to(end, F.col("leader_score"), F.col("leader_id"))
    reason = (
        F.when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when((F.col("signals") != F.col("leader_signals")) & led, "conflicting_with_selected")
        .when((F.col("signals") == F.col("leader_signals")) & fits, F.lit(None).cast("string"))
        .otherwise("capacity_exceeded")
    )
    return joined.select(*scored.columns, *_outcome(reason))


def select_with_comparisons(
    scored: DataFrame, comparisons: DataFrame, policy: SelectionPolicy, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Greedy selection where conflicts come from a caller's comparisons.

    The conflict graph of the eligible subjects falls into components, and each is walked in rank order by itself; subjects
    without a conflict are free. A selection's capacity then cuts the free ones at one place in rank order.
    """
    policy = policy.checked()
    judged = cut_lineage(scored.withColumn("_reason", _eligibility(policy)))
    eligible = judged.where("_reason is null").select("subject_id", (-F.col("score")).alias("key"))
    ends = write_copy(comparisons.where("verdict = 'conflicting'").select("left_subject_id", "right_subject_id"))

    def keyed(side: str) -> DataFrame:
        return eligible.select(F.col("subject_id").alias(f"{side}_subject_id"), F.col("key").alias(f"{side}_key"))

    def place(side: str) -> Column:
        return F.struct(F.col(f"{side}_key").alias("key"), F.col(f"{side}_subject_id").alias("id"))

    known = ends
    for side, other in (("left", "right"), ("right", "left")):
        column = f"{side}_subject_id"
        known = spread_join(known, keyed(side), [column], [f"{other}_subject_id"], hot_rows=hot_rows)
    pair = F.greatest(place("left"), place("right")), F.least(place("left"), place("right"))
    links = known.where("left_key is not null and right_key is not null and left_subject_id <> right_subject_id").select(
        pair[1]["id"].alias("better"),
        pair[1]["key"].alias("better_key"),
        pair[0]["id"].alias("worse"),
        pair[0]["key"].alias("worse_key"),
    )
    links = write_copy(links)
    linked = links.select(F.col("better").alias("subject_id")).unionByName(links.select(F.col("worse").alias("subject_id")))
    alone = eligible.select("subject_id").join(linked.distinct(), "subject_id", "left_anti")
    chosen = alone.unionByName(greedy_choice(links, hot_rows))
    free = chosen.join(judged.select("subject_id", "score"), "subject_id")
    end = _capacity_end(free, policy)
    fitting = free if end is None else free.where(_up_to(end, F.col("score"), F.col("subject_id")))
    kept = fitting.select("subject_id").withColumn("_kept", F.lit(True))
    blocked = (
        ends.select(F.col("left_subject_id").alias("kept_id"), F.col("right_subject_id").alias("subject_id"))
        .union(ends.select("right_subject_id", "left_subject_id"))
        .join(kept.select(F.col("subject_id").alias("kept_id")), "kept_id", "left_semi")
        .join(keyed("kept").select(F.col("kept_subject_id").alias("kept_id"), "kept_key"), "kept_id")
        .groupBy("subject_id")
        .agg(F.min(F.struct("kept_key", "kept_id")).alias("_block"))
    )
    marked = judged.join(kept, "subject_id", "left").join(blocked, "subject_id", "left")
    own = F.struct((-F.col("score")).alias("kept_key"), F.col("subject_id").alias("kept_id"))
    reason = (
        F.when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(F.col("_kept").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("_block") < own, "conflicting_with_selected")
        .otherwise("capacity_exceeded")
    )
    return marked.select(*scored.columns, *_outcome(reason))


def is_selected(selection: DataFrame, subject_id: str) -> bool:
    return bool(selection.where(F.col("selected") & (F.col("subject_id") == subject_id)).limit(1).collect())


def require_no_conflict(selected: DataFrame, comparisons: DataFrame) -> None:
    """No two selected subjects may be compared as conflicting."""
    conflicts = comparisons.where("verdict = 'conflicting'")
    for side in ("left_subject_id", "right_subject_id"):
        conflicts = conflicts.join(selected.select(F.col("subject_id").alias(side)), side, "left_semi")
    require_empty(conflicts, "two selected subjects conflict")


def merge_selected(subjects: DataFrame, scored: DataFrame, selected: DataFrame) -> DataFrame:
    """Members of the merged set: selected subjects with their description and score."""
    return (
        selected.select("subject_id")
        .join(subjects.select("subject_id", "repository_id", "name", "kind", "relative_path"), "subject_id")
        .join(scored.select("subject_id", "score"), "subject_id")
    )


def require_mergeable(subjects: DataFrame, scored: DataFrame, selected: DataFrame) -> None:
    require_empty(missing(selected, "subject_id", subjects, "subject_id"), "a selected subject is unknown")
    require_empty(missing(selected, "subject_id", scored, "subject_id"), "a selected subject has no score")


def member(members: DataFrame, subject_id: str) -> DataFrame:
    return require_found(members.where(F.col("subject_id") == subject_id), f"no member '{subject_id}'")


def _member_text() -> Column:
    fields = F.struct(
        "subject_id", F.col("repository_id").cast("string").alias("repository_id"), "name", "kind", "relative_path", "score"
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})


def member_documents(members: DataFrame) -> DataFrame:
    """One JSON document and checksum per member."""
    document = _member_text()
    return members.select("subject_id", "score", document.alias("document"), export_checksum(document).alias("checksum"))


def digest_tree(members: DataFrame, fan_out: int = 1024) -> DataFrame:
    """(level, place, digest) of a hash tree over the members in rank order.

    A leaf is the checksum of a member's canonical document; a node is the SHA-256 of up to ``fan_out`` digests below it, as
    text, one after the other. Places follow from ranks alone, so the tree is the same for any partitioning, no node needs more
    than ``fan_out`` digests in one place, and two exports are compared from the root down. No members give one root, the
    digest of the empty text.
    """
    if fan_out < 2:
        raise ValidationError("fan_out must be at least 2")
    ranked = distributed_rank(member_documents(members).drop("document"), rank_order(), "place")
    level = cut_lineage(
        ranked.select(F.lit(0).alias("level"), (F.col("place") - 1).alias("place"), F.col("checksum").alias("digest"))
    )
    levels, count, height = [level], level.count(), 0
    while count > 1:
        height, count = height + 1, -(-count // fan_out)
        below = F.array_sort(F.collect_list(F.struct("place", "digest")))
        joined = F.array_join(F.transform(below, lambda x: x["digest"]), "")
        level = cut_lineage(
            level.groupBy(F.floor(F.col("place") / fan_out).cast("bigint").alias("above"))
            .agg(F.sha2(joined.cast("binary"), 256).alias("digest"))
            .select(F.lit(height).alias("level"), F.col("above").alias("place"), "digest")
        )
        levels.append(level)
    if not count:
        return members.sparkSession.range(1).select(
            F.lit(0).alias("level"), F.col("id").alias("place"), F.sha2(F.lit("").cast("binary"), 256).alias("digest")
        )
    return reduce(DataFrame.unionByName, levels)


def export_manifest(members: DataFrame, format_version: str = FORMAT_VERSION, fan_out: int = 1024) -> DataFrame:
    """One row for a merge of any size: version, number of members and the root of their hash tree."""
    tree = digest_tree(members, fan_out)
    return tree.agg(F.max(F.struct("level", "digest"))["digest"].alias("root")).join(
        members.agg(F.count("*").alias("member_count")), F.lit(True)
    ).select(F.lit(format_version).alias("format_version"), "member_count", "root")  # one row each


def _document_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksum of the one document that holds all members, fed member by member."""
    digest, count = hashlib.sha256(b'{"members":['), 0
    for batch in batches:
        for text in batch.column("document").to_pylist():
            digest.update(b"," * (count > 0) + text.encode())
            count += 1
    digest.update(b"]}")
    yield pa.RecordBatch.from_pydict(
        {"member_count": pa.array([count], pa.int64()), "checksum": pa.array([digest.hexdigest()])}
    )


def export_members(members: DataFrame, format_version: str = FORMAT_VERSION) -> DataFrame:
    """Version, number of members and the checksum of the canonical document that lists all members in rank order.

    The checksum runs through one document from its first byte to its last, so one task reads the members in order; it holds a
    batch of them at a time, never the document. ``export_manifest`` is the form that many tasks compute.
    """
    texts = members.select("score", "subject_id", canonical_json(_member_text()).alias("document"))
    ordered = texts.repartition(1).sortWithinPartitions(*rank_order()).select("document")
    return ordered.mapInArrow(_document_digest, "member_count bigint, checksum string").select(
        F.lit(format_version).alias("format_version"), "member_count", "checksum"
    )


def export_document(members: DataFrame) -> DataFrame:
    """The document itself as one ``payload`` text; for merges whose document is wanted as one value."""
    keyed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank_key"), "subject_id", _member_text().alias("t"))))
    listed = F.array_join(F.transform(keyed, lambda row: row["t"]), ",")
    return members.agg(F.concat(F.lit('{"members":['), listed, F.lit("]}")).alias("payload"))
