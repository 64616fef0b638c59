"""Mix sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in a hashed order, repeated up to
``MAX_REPEATS`` times. A document's virtual finish time is the number of its source's
tokens served up to its end, divided by the source's target. All queue entries are put
in ranges of virtual time and served in that order until the total budget is spent.

Defined results: null text has size 0; a null source is a source of its own, ranked
last; documents of size 0 are never taken; rows equal in id and text are served
together, so they are taken alike; an empty table gives an empty result. Columns other
than the four that are read are left alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitrank.session import cut_lineage

#: How often a document may be taken.
MAX_REPEATS = 3
#: Sources weigh 1, 2, 3, 1, 2, 3 ... in code point order.
WEIGHT_CYCLE = 3
#: Ranges of virtual time; only the range in which the budget ends is sorted as rows.
TIME_RANGES = 65_536
#: Rows aimed at in one range of a source's queue.
ROWS_PER_RANGE = 4_096
#: Source tables up to this many rows are shipped to the tasks, larger ones are joined.
SHIPPED_SOURCES = 100_000

_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text``, 0 for null.

    Every word becomes one letter, so that no array of words is built. The added word
    makes a match certain.
    """
    whole = F.concat(F.coalesce(text, F.lit("")), F.lit(" x"))
    return (F.length(F.regexp_replace(whole, _WORD, "x")) - 1).cast("long")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """Fixed-width key whose order is the shuffled order of a source's queue."""
    as_text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.md5(F.concat(as_text, F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Rank, weight and target of every ``(source, source_size)`` row.

    The sources share the sum of all sizes by weight. A target stops at
    ``MAX_REPEATS`` times its source's size and the rest is shared again, which ends
    at one level: ordered by capacity per weight, a source is capped as long as the
    level that its predecessors leave is above its own capacity. The table has one row
    per source, so its windows are as long as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("capacity") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", (F.col("rank") - 1) % WEIGHT_CYCLE + 1)
        .withColumn("capacity", F.col("source_size") * MAX_REPEATS)
        .withColumn("budget", F.sum("source_size").over(everything))
    )
    filled = ranked.withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    ).withColumn("capped", F.col("capacity") / F.col("weight") < F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("capacity").cast("double")).otherwise(
        F.col("weight") * level
    )
    return filled.withColumn("target", target).select(
        "source", "source_size", "rank", "weight", "target", "budget"
    )


@dataclass(frozen=True)
class Mix:
    """What a mix decides: the measured queue entries, and each source's last keys."""

    measured: DataFrame
    sources: DataFrame
    shipped: bool

    def mark(self, docs: DataFrame, source: Column, key: Column, size: Column, name: str):
        """``docs`` with a struct column ``name``: source_size, target, repeats, taken."""
        repeats = sum(
            F.when((size > 0) & (key <= F.col(f"__mix.last.r{turn}")), 1).otherwise(0)
            for turn in range(MAX_REPEATS)
        )
        table = self.sources.select(
            F.struct(*[F.col(c) for c in self.sources.columns]).alias("__mix")
        )
        if self.shipped:
            table = F.broadcast(table)
        marked = docs.join(table, source.eqNullSafe(F.col("__mix.source")), "left")
        outcome = F.struct(
            F.col("__mix.source_size").alias("source_size"),
            F.col("__mix.target").alias("target"),
            repeats.cast("int").alias("repeats"),
            (size * repeats).cast("long").alias("taken"),
        )
        return marked.withColumn(name, outcome).drop("__mix")


def plan_mix(docs: DataFrame) -> Mix:
    """Measure ``docs`` (doc_id, text, source) and decide what the mix takes."""
    measured = cut_lineage(docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"),
        shuffle_key(F.col("doc_id"), F.col("text")).alias("key"),
    ))
    totals = measured.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")
    )
    counted = cut_lineage(totals)
    targets = source_targets(counted.select("source", "source_size"))
    n_sources, n_docs, budget = counted.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("documents"), F.lit(0)),
        F.coalesce(F.sum("source_size"), F.lit(0)),
    ).first()
    shipped = n_sources <= SHIPPED_SOURCES
    ship = F.broadcast if shipped else (lambda df: df)
    sources = cut_lineage(targets)

    # Served tokens up to the end of each entry: sums of key ranges, then inside a range.
    digits = 1
    while 16**digits * ROWS_PER_RANGE < n_docs:
        digits += 1
    entries = (
        measured.where(F.col("size") > 0)
        .join(ship(sources.select(F.col("source").alias("known"), "rank", "source_size", "target")),
              F.col("source").eqNullSafe(F.col("known")))
        .groupBy("rank", "key")
        .agg(F.sum("size").alias("size"), F.first("source_size").alias("source_size"),
             F.first("target").alias("target"))
        .withColumn("range", F.substring("key", 1, digits))
    )
    ranges = entries.groupBy("rank", "range").agg(F.sum("size").alias("range_size"))
    earlier = (
        Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranges = ranges.select(
        "rank", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("ahead")
    )
    inside = (
        Window.partitionBy("rank", "range").orderBy("key")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    turns = F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)))
    served = F.col("turn") * F.col("source_size") + F.col("ahead") + F.col("inside")
    queue = cut_lineage(
        entries.join(ranges, ["rank", "range"])
        .withColumn("inside", F.sum("size").over(inside))
        .withColumn("turn", turns)
        .withColumn("finish", served / F.col("target"))
        .withColumn("slot", F.floor(F.col("finish") / (F.col("finish") + 1) * TIME_RANGES))
        .select("rank", "key", "turn", "size", "finish", "slot")
    )

    # The range of virtual time in which the budget ends, and the entries served in it.
    so_far = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = queue.groupBy("slot").agg(F.sum("size").alias("slot_size")).withColumn(
        "served", F.sum("slot_size").over(so_far)
    )
    last = slots.where(F.col("served") > budget).orderBy("slot").first()
    if last is None:
        taken = queue
    else:
        in_order = (
            Window.orderBy("finish", "rank", "turn", "key")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        room = budget - (last["served"] - last["slot_size"])
        partly = (
            queue.where(F.col("slot") == last["slot"])
            .withColumn("served", F.sum("size").over(in_order))
            .where(F.col("served") <= room).drop("served")
        )
        taken = queue.where(F.col("slot") < last["slot"]).unionByName(partly)
    ends = taken.groupBy("rank").agg(F.struct(*[
        F.max(F.when(F.col("turn") == turn, F.col("key"))).alias(f"r{turn}")
        for turn in range(MAX_REPEATS)
    ]).alias("last"))
    decided = cut_lineage(sources.join(ends, "rank", "left"))
    return Mix(measured, decided, shipped)


def mix_report(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document: size, source_size, target, repeats, taken."""
    mix = plan_mix(docs)
    marked = mix.mark(mix.measured, F.col("source"), F.col("key"), F.col("size"), "outcome")
    return marked.select("doc_id", "size", "outcome.*")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: ``docs`` with every row as often as the mix takes it."""
    mix = plan_mix(docs)
    # A row is one column here, so that its own names cannot clash with working ones.
    sized = docs.select(
        F.struct("*").alias("row"), "source", word_count(F.col("text")).alias("size"),
        shuffle_key(F.col("doc_id"), F.col("text")).alias("key"),
    )
    marked = mix.mark(sized, F.col("source"), F.col("key"), F.col("size"), "outcome")
    repeated = marked.where(F.col("outcome.repeats") > 0).select(
        "row", F.explode(F.sequence(F.lit(1), F.col("outcome.repeats"))).alias("turn")
    )
    return repeated.select("row.*")


REPORT_SQL = r"""
WITH m AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM m GROUP BY source
), w AS (
    SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 AS capacity FROM s
), f AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(capacity) OVER b, 0) AS DOUBLE)
        / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
    FROM w WINDOW b AS (ORDER BY capacity / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, rank, CASE WHEN capacity / weight < level THEN CAST(capacity AS DOUBLE)
        ELSE weight * max(level) FILTER (WHERE capacity / weight >= level) OVER () END AS target
    FROM f
), e AS (
    SELECT t.rank, m.key, sum(m.size) AS size, any_value(source_size) AS source_size,
        any_value(target) AS target
    FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source WHERE m.size > 0 GROUP BY 1, 2
), q AS (
    SELECT rank, key, turn, size, CAST(turn * source_size + sum(size) OVER
        (PARTITION BY rank, turn ORDER BY key ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target AS finish
    FROM e, (SELECT unnest([0, 1, 2]) AS turn)
), o AS (
    SELECT *, sum(size) OVER (ORDER BY finish, rank, turn, key ROWS UNBOUNDED PRECEDING) AS served FROM q
), k AS (
    SELECT rank, key, count(*) AS repeats FROM o
    WHERE served <= (SELECT sum(size) FROM m) GROUP BY 1, 2
)
SELECT m.doc_id, m.size, t.source_size, t.target, CAST(coalesce(k.repeats, 0) AS INTEGER) AS repeats,
    CAST(m.size * coalesce(k.repeats, 0) AS BIGINT) AS taken
FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON k.rank = t.rank AND k.key = m.key
"""
