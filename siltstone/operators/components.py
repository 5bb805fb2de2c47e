"""Connected components of very large graphs, and greedy choice within them."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.spread import HOT_ROWS, spread_join
from siltstone.session import cut_lineage, write_copy

# Links of a component that one task decides in one pass; larger components are thinned first.
COMPONENT_LINKS = 500_000


def connected_components(links: DataFrame, a: str, b: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``node`` and ``component`` (the smallest node it is linked to over any way) for every node of ``links``.

    Each round ties every node's larger neighbours, then its smaller ones, to the smallest of them (large and small stars,
    Kiveris et al. 2014), so the number of rounds grows with the logarithm of the longest way. Minima are partial
    before they are shuffled, and the links of a hub are dealt out over many tasks. Links of a node to itself, repeated links
    and null ends do not matter.
    """

    def tied(held: DataFrame, least: DataFrame) -> DataFrame:
        """The other ends of each ``u`` of ``held`` with the minimum of ``u``."""
        return spread_join(held, least, ["u"], ["v"], least.select("u", "rows"), hot_rows).select("v", "m")

    def minima(held: DataFrame) -> DataFrame:
        return cut_lineage(held.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")))

    held = cut_lineage(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = None
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = minima(both).withColumn("m", F.least("u", "m"))
        large = cut_lineage(
            tied(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        lower = minima(large)
        small = tied(large, lower).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = cut_lineage(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        state = held.agg(
            F.count("*"), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()  # one row
        if state == before and state[0] == state[1]:  # every node is tied to one root and nothing moves
            break
        before = state
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _walk(group: pa.Table) -> pa.Table:
    """Greedy choice in one component: nodes in rank order, each chosen unless a better neighbour was. Gives those not chosen."""
    better, worse = defaultdict(list), {}
    for row in group.select(["better_key", "better", "worse_key", "worse"]).to_pylist():
        one, other = (row["better_key"], row["better"]), (row["worse_key"], row["worse"])
        better[other].append(one)
        worse[one] = worse[other] = None
    chosen = set()
    for node in sorted(worse):
        if not any(x in chosen for x in better[node]):
            chosen.add(node)
    return pa.table({"subject_id": pa.array([x[1] for x in sorted(worse) if x not in chosen], pa.string())})


def _thinned(links: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(losers, links left) of a round in which all nodes without a better neighbour are chosen and their neighbours dropped."""
    beaten = links.select(F.col("worse").alias("better")).distinct()
    winners = links.select("better").distinct().join(beaten, "better", "left_anti").withColumn("won", F.lit(True))
    marked = spread_join(links, cut_lineage(winners), ["better"], ["worse"], hot_rows=hot_rows)
    losers = cut_lineage(marked.where("won").select(F.col("worse").alias("subject_id")).distinct())
    left = links
    # The links of a chosen node lead to losers, so they go with those.
    for side, other in (("better", "worse"), ("worse", "better")):
        lost = losers.select(F.col("subject_id").alias(side), F.lit(True).alias("lost"))
        left = spread_join(left, lost, [side], [other], hot_rows=hot_rows).where("lost is null").drop("lost")
    return losers, write_copy(left.select(*links.columns))


def greedy_choice(links: DataFrame, hot_rows: int = HOT_ROWS, component_links: int = COMPONENT_LINKS) -> DataFrame:
    """``subject_id`` of every linked node that a walk in rank order (key, then id) chooses: it has no better chosen neighbour.

    ``links`` hold ``better``, ``better_key``, ``worse`` and ``worse_key``. Rounds choose all nodes without a better
    neighbour and drop their neighbours, as long as each leaves no more than half of the links. Where long chains make
    rounds slow, components, which are independent, are told apart: each of up to ``component_links`` links is walked in
    one pass, however long its chains, and so are all that are left once they have no more together. Larger ones go on in
    rounds. A node that no round and no walk drops is chosen.
    """
    links = write_copy(links.distinct())
    nodes = links.select(F.col("better").alias("subject_id")).unionByName(links.select(F.col("worse").alias("subject_id"))).distinct()
    lost, before = [], None
    while True:
        count = links.count()
        if count <= component_links:  # what is left needs not be told apart to be walked
            lost.append(cut_lineage(links.groupBy(F.lit("")).applyInArrow(_walk, "subject_id string")))
            break
        if before is not None and count > before // 2:
            parts = connected_components(links, "better", "worse", hot_rows).toDF("better", "component")
            placed = spread_join(links, parts, ["better"], ["worse"], hot_rows=hot_rows)
            sizes = placed.groupBy("component").agg(F.count("*").alias("rows"))
            sized = sizes.withColumn("giant", F.col("rows") > component_links)
            placed = cut_lineage(spread_join(placed, sized, ["component"], ["better", "worse"], sizes, hot_rows))
            small = placed.where("not giant")
            lost.append(cut_lineage(small.groupBy("component").applyInArrow(_walk, "subject_id string")))
            links = placed.where("giant").select(*links.columns)
            count = links.count()
        losers, links = _thinned(links, hot_rows)
        lost.append(losers)
        before = count
    return nodes.join(reduce(DataFrame.unionByName, lost), "subject_id", "left_anti")
