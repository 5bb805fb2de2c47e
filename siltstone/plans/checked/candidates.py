"""Comparison, ranking, selection, merge and export with parts in the role of reuse candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.documents import export_checksum
from siltstone.operators import candidates
from siltstone.operators.candidates import SelectionPolicy
from siltstone.operators.checks import missing
from siltstone.plans.checked import query, table

POLICY = SelectionPolicy(minimum_score=0.25, maximum_selected=60)


def part_subjects(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").selectExpr(
        "'parts' as repository_id",
        "concat('f', p_partkey, '.py') as relative_path",
        "concat('n', p_partkey % 40) as name",
        "p_type as kind",
        "p_size > 25 as is_public",
        "p_retailprice > 950 as has_docstring",
        "array_sort(array(p_brand, concat('size', p_size % 5))) as signals",
        "(p_partkey % 97) / 97.0D as score",
    )
    return candidates.build_subjects(parts)


_SUBJECTS = """with s as (select 'parts:f' || p_partkey || '.py::n' || p_partkey % 40 as subject_id, 'n' || p_partkey % 40 as name, p_type as kind,
      list_sort([p_brand, 'size' || p_size % 5]) as signals, (p_partkey % 97) / 97.0::double as score,
      'f' || p_partkey || '.py' as relative_path, p_size > 25 as is_public, p_retailprice > 950 as has_docstring from part)"""


@query(
    "subject_ids",
    f"""{_SUBJECTS} select subject_id, round(case when is_public then 0.5 else 0 end + case when has_docstring then 0.3 else 0 end + 0.08, 6)::double
    as score from s""",
)
def subject_ids(spark: SparkSession, folder: str) -> DataFrame:
    scored = candidates.score_subjects(candidates.require_unique_subjects(part_subjects(spark, folder)))
    return scored.select("subject_id", F.round("score", 6).alias("score"))


@query(
    "verdict_counts",
    f"""{_SUBJECTS}, v as (select case when a.kind = b.kind and a.name = b.name and a.signals = b.signals then 'equivalent'
      when a.kind = b.kind and a.name = b.name then 'conflicting'
      when a.kind = b.kind and list_has_any(a.signals, b.signals) then 'compatible' else 'distinct' end as verdict
      from s a join s b on a.subject_id < b.subject_id)
    select verdict, count(v.verdict)::bigint as pairs from
    (select unnest(['equivalent', 'conflicting', 'compatible', 'distinct']) as verdict) left join v using (verdict) group by verdict""",
)
def verdict_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = candidates.verdict_counts(part_subjects(spark, folder))
    return counts.withColumn("pairs", F.col("pairs").cast("bigint"))  # the check SQL counts in 64 bits


@query(
    "pair_verdicts",
    f"""{_SUBJECTS}, p as (select distinct least(a.l_partkey, b.l_partkey) as x, greatest(a.l_partkey, b.l_partkey) as y
      from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey)
    select a.subject_id as left_subject_id, b.subject_id as right_subject_id,
    case when a.kind = b.kind and a.name = b.name and a.signals = b.signals then 'equivalent'
    when a.kind = b.kind and a.name = b.name then 'conflicting'
    when a.kind = b.kind and list_has_any(a.signals, b.signals) then 'compatible' else 'distinct' end as verdict,
    array_to_string(list_sort(list_intersect(a.signals, b.signals)), ',') as shared_signals
    from p join s a on a.subject_id = 'parts:f' || x || '.py::n' || x % 40 join s b on b.subject_id = 'parts:f' || y || '.py::n' || y % 40""",
)
def pair_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of parts that follow each other in an order."""
    outcomes = candidates.compare_pairs(_neighbours(spark, folder), part_subjects(spark, folder))
    return outcomes.withColumn("shared_signals", F.array_join("shared_signals", ","))


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different parts on consecutive lines of an order: at most one pair per line item."""
    lines = table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey as x")
    following = lines.selectExpr("l_orderkey", "l_linenumber - 1 as l_linenumber", "x as y")
    pairs = lines.join(following, ["l_orderkey", "l_linenumber"]).where("x <> y").selectExpr("least(x, y) as x", "greatest(x, y) as y").distinct()
    return pairs.selectExpr(
        "concat('parts:f', x, '.py::n', x % 40) as left_subject_id", "concat('parts:f', y, '.py::n', y % 40) as right_subject_id"
    )


@query(
    "leader_comparisons",
    f"""{_SUBJECTS}, l as (select *, first(subject_id) over w as leader_id, first(signals) over w as leader_signals from s
      window w as (partition by kind, name order by score desc, subject_id))
    select leader_id as left_subject_id, subject_id as right_subject_id,
    case when signals = leader_signals then 'equivalent' else 'conflicting' end as verdict,
    array_to_string(list_sort(list_intersect(signals, leader_signals)), ',') as shared_signals from l where leader_id <> subject_id""",
)
def leader_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = candidates.compare_to_leaders(part_subjects(spark, folder))
    return outcomes.withColumn("shared_signals", F.array_join("shared_signals", ","))


@query(
    "rank_all",
    f"{_SUBJECTS} select subject_id, row_number() over (order by score desc, subject_id)::bigint as rank from s",
)
def rank_all(spark: SparkSession, folder: str) -> DataFrame:
    return candidates.rank_subjects(part_subjects(spark, folder).select("subject_id", "score")).select("subject_id", "rank")


@query(
    "rank_top",
    f"{_SUBJECTS} select subject_id, round(score, 6) as score from s order by s.score desc, subject_id limit 25",
)
def rank_top(spark: SparkSession, folder: str) -> DataFrame:
    return candidates.top(part_subjects(spark, folder), 25).select("subject_id", F.round("score", 6).alias("score"))


_SELECTION = f"""{_SUBJECTS},
    e as (select *, first(subject_id) over w as leader_id, first(signals) over w as leader_signals from s where score >= 0.25
      window w as (partition by kind, name order by score desc, subject_id)),
    k as (select subject_id from e where signals = leader_signals order by score desc, subject_id limit 60),
    r as (select s.subject_id, case when s.score < 0.25 then 'below_minimum_score' when s.subject_id in (select subject_id from k) then null
      when e.signals <> e.leader_signals and e.leader_id in (select subject_id from k) then 'conflicting_with_selected'
      else 'capacity_exceeded' end as reason from s left join e on e.subject_id = s.subject_id)"""


@query("select_policy", f"{_SELECTION} select subject_id, reason is null as selected, reason from r")
def select_policy(spark: SparkSession, folder: str) -> DataFrame:
    selection = candidates.select_subjects(part_subjects(spark, folder), POLICY)
    return selection.select("subject_id", "selected", "reason")


@query(
    "select_without_cap",
    f"""{_SUBJECTS}, e as (select *, first(signals) over (partition by kind, name order by score desc, subject_id) as leader_signals
      from s where score >= 0.25 and kind = 'ECONOMY')
    select s.subject_id, e.signals = e.leader_signals is true as selected, case when s.score < 0.25 then 'below_minimum_score'
    when s.kind <> 'ECONOMY' then 'kind_mismatch' when e.signals <> e.leader_signals then 'conflicting_with_selected' end as reason
    from s left join e on e.subject_id = s.subject_id""",
)
def select_without_cap(spark: SparkSession, folder: str) -> DataFrame:
    selection = candidates.select_subjects(part_subjects(spark, folder), SelectionPolicy(0.25, None, "ECONOMY"))
    return selection.select("subject_id", "selected", "reason")


@query(
    "select_with_comparisons",
    f"""with recursive {_SUBJECTS.removeprefix("with ")},
    p as (select distinct least(a.l_partkey, b.l_partkey) as x, greatest(a.l_partkey, b.l_partkey) as y
      from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey),
    c as (select 'parts:f' || a || '.py::n' || a % 40 as subject_id, list('parts:f' || b || '.py::n' || b % 40) as others
      from (select x as a, y as b from p union all select y, x from p) group by a),
    o as (select s.subject_id, score, coalesce(others, []) as others, row_number() over (order by score desc, s.subject_id) as i
      from s left join c on c.subject_id = s.subject_id where score >= 0.25),
    walk as (select 0::bigint as i, null::varchar as subject_id, []::varchar[] as chosen, null::varchar as reason
      union all select o.i, o.subject_id,
      case when list_has_any(o.others, chosen) or len(chosen) >= 60 then chosen else list_append(chosen, o.subject_id) end,
      case when list_has_any(o.others, chosen) then 'conflicting_with_selected'
        when len(chosen) >= 60 then 'capacity_exceeded' end
      from walk join o on o.i = walk.i + 1)
    select s.subject_id, score >= 0.25 and reason is null as selected,
    case when score < 0.25 then 'below_minimum_score' else reason end as reason from s left join walk on walk.subject_id = s.subject_id""",
)
def select_with_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring parts as conflicts; the check SQL walks all subjects in rank order."""
    conflicts = _neighbours(spark, folder).withColumn("verdict", F.lit("conflicting"))
    selection = candidates.select_with_comparisons(part_subjects(spark, folder), conflicts, POLICY)
    return selection.select("subject_id", "selected", "reason")


@query(
    "merge_members",
    f"""{_SELECTION} select s.subject_id, 'parts' as repository_id, name, kind, relative_path, round(score, 6) as score
    from s join r on r.subject_id = s.subject_id where reason is null""",
)
def merge_members(spark: SparkSession, folder: str) -> DataFrame:
    subjects = part_subjects(spark, folder)
    selected = candidates.select_subjects(subjects, POLICY).where("selected")
    return candidates.merge_selected(subjects, subjects, selected).withColumn("score", F.round("score", 6))


@query(
    "unmatched_customers",
    "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
)
def unmatched_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The integrity test behind selection and merge: keys absent from the other relation."""
    return missing(table(spark, folder, "customer").select("c_custkey"), "c_custkey", table(spark, folder, "orders"), "o_custkey")


@query(
    "export_checksum",
    """select n_nationkey, sha256('{"members":[{"kind":"nation","name":"' || n_name || '","note":null,"region":' || n_regionkey || '}]}') as checksum
    from nation""",
)
def export_checksums(spark: SparkSession, folder: str) -> DataFrame:
    document = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("n_regionkey").alias("region"),
                    F.lit("nation").alias("kind"),
                    F.col("n_name").alias("name"),
                    F.lit(None).cast("string").alias("note"),
                )
            ).alias("members")
        ),
        {"ignoreNullFields": "false"},
    )
    return table(spark, folder, "nation").select("n_nationkey", export_checksum(document).alias("checksum"))


@query(
    "export_members",
    f"""{_SELECTION}, m as (select s.subject_id, s.score, '{{"kind":"' || kind || '","name":"' || name || '","relative_path":"' || relative_path
      || '","repository_id":"parts","score":' || score || ',"subject_id":"' || s.subject_id || '"}}' as document
      from s join r on r.subject_id = s.subject_id where reason is null)
    select '1.0' as format_version, count(*)::bigint as member_count,
    sha256('{{"members":[' || string_agg(document, ',' order by score desc, subject_id) || ']}}') as checksum from m""",
)
def export_members(spark: SparkSession, folder: str) -> DataFrame:
    subjects = part_subjects(spark, folder)
    selected = candidates.select_subjects(subjects, POLICY).where("selected")
    members = candidates.merge_selected(subjects, subjects, selected)
    return candidates.export_members(members)


@query(
    "export_manifest",
    """with p as (select p_partkey, p_size / 100.0::double as score, 'parts:' || lpad(p_partkey::varchar, 9, '0') as subject_id,
      'n' || p_partkey as name, p_brand as kind, 'f' || p_partkey as relative_path from part),
    leaves as (select row_number() over (order by score desc, subject_id) - 1 as place, sha256('{"kind":"' || kind || '","name":"'
      || name || '","relative_path":"' || relative_path || '","repository_id":"parts","score":' || score || ',"subject_id":"'
      || subject_id || '"}') as digest from p),
    a as (select place // 16 as place, sha256(string_agg(digest, '' order by place)) as digest from leaves group by place // 16),
    b as (select place // 16 as place, sha256(string_agg(digest, '' order by place)) as digest from a group by place // 16),
    c as (select place // 16 as place, sha256(string_agg(digest, '' order by place)) as digest from b group by place // 16),
    d as (select place // 16 as place, sha256(string_agg(digest, '' order by place)) as digest from c group by place // 16),
    e as (select place // 16 as place, sha256(string_agg(digest, '' order by place)) as digest from d group by place // 16)
    select '1.0' as format_version, n::bigint as member_count, case when n <= 16 then (select max(digest) from a)
      when n <= 256 then (select max(digest) from b) when n <= 4096 then (select max(digest) from c)
      when n <= 65536 then (select max(digest) from d) else (select max(digest) from e) end as root
    from (select count(*) as n from part)""",
)
def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """All parts as members of one merge, in a tree of sixteens."""
    members = table(spark, folder, "part").selectExpr(
        "concat('parts:', lpad(p_partkey, 9, '0')) as subject_id",
        "'parts' as repository_id",
        "concat('n', p_partkey) as name",
        "p_brand as kind",
        "concat('f', p_partkey) as relative_path",
        "p_size / 100.0D as score",
    )
    return candidates.export_manifest(members, fan_out=16)


@query(
    "member_checksums",
    f"""{_SELECTION} select s.subject_id, sha256('{{"kind":"' || kind || '","name":"' || name || '","relative_path":"' || relative_path
    || '","repository_id":"parts","score":' || score || ',"subject_id":"' || s.subject_id || '"}}') as checksum
    from s join r on r.subject_id = s.subject_id where reason is null""",
)
def member_checksums(spark: SparkSession, folder: str) -> DataFrame:
    subjects = part_subjects(spark, folder)
    selected = candidates.select_subjects(subjects, POLICY).where("selected")
    members = candidates.merge_selected(subjects, subjects, selected)
    return candidates.member_documents(members).select("subject_id", "checksum")
