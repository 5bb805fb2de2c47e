"""Mix of sources to target weights, in blocks of a fixed number of words, with DataFrame and SQL functions only.

The words of each source, in a fixed order of its documents, are cut into blocks of ``block`` words. The mix has as
many slots as the blocks its targets need, dealt out to shards. In each shard every slot draws its source, so that a
shard's source counts are multinomial; a source's slots are then numbered through all shards. Draws beyond a source's
quota go to the sources that are short of theirs, so that totals meet the targets. The numbered slots of a source pass
its blocks again and again, each time through another pseudorandom permutation of the block indexes, and meet the
blocks by a join on the index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import cut_lineage, task_count


@dataclass(frozen=True)
class Settings:
    """``weights`` repeat over the sources in order; ``most`` times a source's size is its highest target."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: int = 3
    block: int = 32
    shard: int = 4096
    seed: int = 17


# Multipliers of the permutations: primes, of which at least one divides no block count below 10^18.
PRIMES = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081, 1_000_099, 1_000_117, 1_000_121)
# Parts of the unit interval by which a draw finds its source.
BUCKETS = 16_384


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, settings: Settings) -> DataFrame:
    """Target of each source (``source``, ``source_size``): weights share the total, no target above ``most`` sizes.

    Sharing the excess by weight until nothing exceeds its limit ends where every source below its limit holds the
    same multiple of its weight. Sources are therefore ordered by limit over weight, and the first multiple that the
    next limit allows is taken.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, settings.weights)),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(settings.weights))) + 1).cast("int"),
    )
    limited = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(settings.most))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    multiple = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    fitted = limited.withColumn("multiple", multiple).withColumn(
        "fits", F.col("multiple") * F.col("weight") <= F.col("limit")
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), F.col("multiple").alias("m")))).over(
        everything
    )
    target = F.least(F.col("limit"), F.coalesce(level["m"] * F.col("weight"), F.col("limit")))
    return fitted.withColumn("target", target).select("source", "source_size", "weight", "target")


def placed_documents(documents: DataFrame) -> DataFrame:
    """Each row with its size and the words of its source before it, in the order of doc_id and text.

    Rows are ordered in ranges of (source, doc_id, text hash), and sums of whole ranges are added to sums within a
    range, so a source of any size is summed by many tasks.
    """
    source = documents.select(
        documents["source"],
        documents["doc_id"],
        word_count(documents["text"]).alias("size"),
        F.xxhash64(documents["text"]).alias("tie"),
    )
    keys = [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("tie")]
    sized = cut_lineage(source)
    ranges = task_count(documents.sparkSession)
    ranged = cut_lineage(
        sized.repartitionByRange(ranges, *keys).withColumn("part", F.spark_partition_id())
    )
    inside = Window.partitionBy("part", "source").orderBy(*keys[1:])
    sums = ranged.groupBy("part", "source").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "part", "source", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")
    )
    rows = ranged.withColumn(
        "place",
        F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    return (
        rows.alias("r")
        .join(offsets.alias("o"), (F.col("r.part") == F.col("o.part")) & F.col("r.source").eqNullSafe(F.col("o.source")))
        .select("r.source", "r.doc_id", "r.tie", "r.size", (F.col("place") + F.col("offset")).alias("place"))
    )


def _permuted(position: Column, turn: Column, count: Column, source: Column, seed: int) -> Column:
    """Index that ``position`` maps to in this source's permutation of 0 to ``count`` - 1 for the pass ``turn``.

    A position times a number without a common divisor with ``count`` steps through all residues; multiplier and
    shift are drawn for each source and pass.
    """
    primes = F.array(*(F.lit(p).cast("bigint") for p in PRIMES))
    first = F.pmod(F.xxhash64(F.lit(seed), source, turn), F.lit(len(PRIMES)))
    rotated = F.concat(F.slice(primes, first + 1, F.lit(len(PRIMES))), F.slice(primes, F.lit(1), first))
    factor = F.element_at(F.filter(rotated, lambda p: count % p != 0), 1)
    shift = F.pmod(F.xxhash64(F.lit(seed + 1), source, turn), count)
    return F.pmod(position * F.pmod(factor, count) + shift, count)


def source_plan(placed: DataFrame, settings: Settings) -> DataFrame:
    """One row per source: size, target, number of blocks, and its quota of slots."""
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / settings.block)
    passes = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - passes * F.col("source_size")
    quota = F.least(
        passes * blocks + F.round(rest / (F.col("source_size") / blocks)).cast("bigint"), blocks * settings.most
    )
    plan = source_targets(sizes, settings).withColumn("blocks", blocks.cast("bigint"))
    quota = F.when(F.col("source_size") > 0, quota).otherwise(0).cast("bigint")
    return plan.withColumn("quota", quota).withColumn(
        "before",
        F.coalesce(
            F.sum("quota").over(
                Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )


def mixed_slots(plan: DataFrame, settings: Settings) -> DataFrame:
    """Every slot of the mix: shard, slot, source, and the block of the source that fills it."""
    spark = plan.sparkSession
    total = int(plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0])  # one number
    # Draw: the slot's random number falls in one source's share. Shares are listed by bucket of the unit interval, so
    # that the lookup is an equi-join on evenly filled buckets, whatever the number of sources.
    share = plan.where("quota > 0").select(
        "source", (F.col("before") / total).alias("low"), ((F.col("before") + F.col("quota")) / total).alias("high")
    )
    shares = share.withColumn(
        "bucket",
        F.explode(
            F.sequence(
                F.floor(F.col("low") * BUCKETS), F.least(F.floor(F.col("high") * BUCKETS), F.lit(BUCKETS - 1))
            )
        ),
    )
    draw = F.pmod(F.xxhash64(F.lit(settings.seed), F.col("slot")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    slots = spark.range(0, total, 1, task_count(spark)).select(F.col("id").alias("slot")).withColumn("u", draw)
    drawn = (
        slots.withColumn("bucket", F.floor(F.col("u") * BUCKETS))
        .join(shares, "bucket")
        .where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        .select("slot", F.floor(F.col("slot") / settings.shard).alias("shard"), "source")
    )
    drawn = cut_lineage(drawn)
    counts = drawn.groupBy("shard", "source").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "source").orderBy("slot")
    numbered = (
        drawn.withColumn("k", F.row_number().over(within) - 1)
        .alias("d")
        .join(
            offsets.alias("o"),
            (F.col("d.shard") == F.col("o.shard")) & F.col("d.source").eqNullSafe(F.col("o.source")),
        )
        .select("d.shard", "d.slot", "d.source", (F.col("k") + F.col("offset")).alias("k"))
    )
    # Beyond the quotas: the e-th slot too many, over all sources, goes to the e-th slot that is missing.
    totals = counts.groupBy("source").agg(F.sum("n").alias("got"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    balance = (
        plan.where("quota > 0")
        .alias("p")
        .join(totals.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "left")
        .select("p.source", "p.blocks", "p.quota", F.coalesce("t.got", F.lit(0)).alias("got"))
        .withColumn("extra", F.greatest(F.lit(0), F.col("got") - F.col("quota")))
        .withColumn("lack", F.greatest(F.lit(0), F.col("quota") - F.col("got")))
        .withColumn("extra_before", F.coalesce(F.sum("extra").over(ordered), F.lit(0)))
        .withColumn("lack_before", F.coalesce(F.sum("lack").over(ordered), F.lit(0)))
    )
    balance = cut_lineage(balance)
    joined = (
        numbered.alias("n")
        .join(balance.alias("b"), F.col("n.source").eqNullSafe(F.col("b.source")))
        .select("n.shard", "n.slot", "n.source", "n.k", "b.blocks", "b.quota", "b.extra_before")
    )
    kept = joined.where("k < quota").select("shard", "slot", "source", "blocks", "k")
    surplus = joined.where("k >= quota").select(
        "shard", "slot", (F.col("extra_before") + F.col("k") - F.col("quota")).alias("e")
    )
    lacking = balance.where("lack > 0").select(
        "source",
        "blocks",
        F.explode(F.sequence(F.lit(0), F.col("lack") - 1)).alias("i"),
        "got",
        "lack_before",
    ).select("source", "blocks", (F.col("got") + F.col("i")).alias("k"), (F.col("lack_before") + F.col("i")).alias("e"))
    moved = surplus.join(lacking, "e").select("shard", "slot", "source", "blocks", "k")
    return kept.unionByName(moved).select(
        "shard",
        "slot",
        "source",
        F.floor(F.col("k") / F.col("blocks")).alias("pass"),
        _permuted(
            F.col("k") % F.col("blocks"), F.floor(F.col("k") / F.col("blocks")), F.col("blocks"), F.col("source"), settings.seed
        ).alias("block"),
    )


def mix(documents: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources' plan, the mix's slots, and which words of which document each used block holds, as three tables."""
    placed = cut_lineage(placed_documents(documents))
    plan = cut_lineage(source_plan(placed, settings))
    slots = mixed_slots(plan, settings)
    size = settings.block
    pieces = (
        placed.where("size > 0")
        .withColumn(
            "block",
            F.explode(
                F.sequence(F.floor(F.col("place") / size), F.floor((F.col("place") + F.col("size") - 1) / size))
            ),
        )
        .withColumn("low", F.greatest(F.col("place"), F.col("block") * size) - F.col("place"))
        .withColumn(
            "high", F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * size) - F.col("place")
        )
    )
    uses = slots.groupBy("source", "block").agg(
        F.count("*").alias("uses"), F.sort_array(F.collect_list("pass")).alias("passes")
    )  # at most ``most`` passes a block
    used = (
        pieces.alias("p")
        .join(
            uses.alias("u"),
            (F.col("p.block") == F.col("u.block")) & F.col("p.source").eqNullSafe(F.col("u.source")),
        )
        .select("p.source", "p.doc_id", "p.tie", "p.place", "p.size", "p.block", "p.low", "p.high", "u.uses", "u.passes")
    )
    return plan, placed, used


def mixed_documents(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Size, source and words taken of every document.

    One row per input row: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``. Null or empty texts have size
    0 and are never taken; a source without words has target 0. A null source is a source of its own, last in order.
    Repeated rows follow each other and are told apart by their place. An empty table gives an empty result. Draws,
    permutations and order depend on the data and the seed only, so reruns agree. Extra columns are not read.
    """
    plan, placed, used = mix(documents, settings)
    taken = used.groupBy("source", "place", "doc_id", "tie").agg(
        F.sum((F.col("high") - F.col("low")) * F.col("uses")).alias("taken")
    )
    empty = placed.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    full = (
        placed.where("size > 0")
        .alias("d")
        .join(
            taken.alias("t"),
            (F.col("d.place") == F.col("t.place")) & F.col("d.source").eqNullSafe(F.col("t.source")),
            "left",
        )
        .select("d.source", "d.doc_id", "d.size", F.coalesce("t.taken", F.lit(0)).alias("taken"))
    )
    return (
        full.unionByName(empty.select("source", "doc_id", "size", "taken"))
        .alias("r")
        .join(plan.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .select("r.doc_id", "r.size", "s.source_size", "s.target", F.col("taken").cast("bigint").alias("taken"))
    )
