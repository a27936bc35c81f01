"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of each source lie on one line per shard, documents in a seeded
order, cut into blocks of equal size. Sources get blocks by highest quotients
of their targets, the shards of a source by highest quotients of their sizes,
and a shard takes its blocks from a seeded place on, round its line as often
as the quota asks for. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiffinlake.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 8
SHARD_DOCS = 4096
SEED = "mix-1"


def _seeded(*columns: Column | str) -> Column:
    """32 hex digits from a seed and some values, null being a value of its own."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) if isinstance(c, str) else c for c in columns]))


def _number(digits: Column) -> Column:
    """The first 7 of hex digits as a number."""
    return F.conv(F.substring(digits, 1, 7), 16, 10).cast("bigint")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words; the key of the source, null having one of its own."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("source_key"),
    )


def targets(by_source: DataFrame, weights: Sequence[int] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """Adds `target` to (source_key, source, source_size, ...): all words shared by weight, no target above its cap.

    Weights repeat over the sources in order of code points, null last. Sorted
    by cap over weight, the sources that stop at their caps come first: the
    first one that the level of the others leaves below its cap ends them.
    One row per source goes through the windows.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("full_at", "place")
    everything = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    return (
        by_source.withColumn("place", F.row_number().over(named))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * most_times)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn(
            "level",
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        )
        .withColumn("filled", F.row_number().over(filled))
        .withColumn("first_below", F.min(F.when(F.col("level") <= F.col("full_at"), F.col("filled"))).over(everything))
        .withColumn("final", F.max(F.when(F.col("filled") == F.col("first_below"), F.col("level"))).over(everything))
        .withColumn("target", F.least(F.col("weight") * F.col("final"), F.col("cap").cast("double")))
        .drop("place", "weight", "cap", "full_at", "level", "filled", "first_below", "final")
    )


def sainte_lague(parties: DataFrame, within: Sequence[str], party: str, claim: str, seats: str, most: str) -> DataFrame:
    """Adds `quota`: `seats` of each group given to its parties by the highest quotients claim / (2 j - 1).

    A party gets no more than `most` seats; equal quotients go by the order of
    `party`. Seats that any threshold gives are counted, not listed: with S
    parties the exact share of each, short by S / 2 shares and one, is sure,
    and only the seats within that distance compete. That is some two rows for
    each party and two for each seat in doubt, O(S) rows in all.
    """
    group = Window.partitionBy(*within)
    share = F.when(F.col("claims") > 0, F.col(claim) / F.col("claims")).otherwise(0.0)
    ranked = parties.withColumn("claims", F.sum(claim).over(group)).withColumn("share", share)
    ranked = (
        ranked.withColumn("doubt", F.ceil(F.count(F.lit(1)).over(group) * F.col("share") / 2).cast("bigint") + 2)
        .withColumn("ideal", F.floor(F.col(seats) * F.col("share")).cast("bigint"))
        .withColumn("sure", F.least(F.col(most), F.greatest(F.lit(0), F.col("ideal") - F.col("doubt"))))
        .withColumn("open", F.least(F.col(most), F.when(F.col(claim) > 0, F.col("ideal") + F.col("doubt")).otherwise(0)))
        .withColumn("left", F.col(seats) - F.sum("sure").over(group))
    )
    order = Window.partitionBy(*within).orderBy(F.col("quotient").desc(), party, "seat")
    won = (
        ranked.where(F.col("open") > F.col("sure"))
        .select(*within, party, "left", claim, F.explode(F.sequence(F.col("sure") + 1, F.col("open"))).alias("seat"))
        .withColumn("quotient", F.col(claim) / (2 * F.col("seat") - 1))
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= F.col("left"))
        .groupBy(*within, party)
        .agg(F.count(F.lit(1)).alias("won"))
    )
    return (
        ranked.join(won, [*within, party], "left")
        .withColumn("quota", F.col("sure") + F.coalesce(F.col("won"), F.lit(0)))
        .drop("claims", "share", "doubt", "ideal", "sure", "open", "left", "won")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_times: int = MOST_TIMES,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target and `taken`, the words the mix takes of each document.

    One row for each row of `docs`. A null text has size 0 and gives nothing; a
    null source is a source. Rows that repeat are documents of their own, and
    equal ones may change places. An empty table gives an empty one; columns
    other than doc_id, source and text are not read. A document may be cut at
    its first or last word by a block. Shards hold some `shard_docs` documents
    of whatever source, so that one with most rows is spread over all of them;
    a source's words differ from its target by `block_words` a shard at most.
    """
    known = written(sizes(docs), "mix-sizes")
    shards = max(1, -(-known.count() // shard_docs))
    placed = known.withColumn("digits", _seeded(F.lit(seed), "doc_id", "size")).withColumn(
        "shard", _number(F.col("digits")) % shards
    )
    by_shard = placed.groupBy("source_key", "source", "shard").agg(F.sum("size").alias("shard_size"))
    by_shard = by_shard.withColumn("blocks", F.ceil(F.col("shard_size") / block_words).cast("bigint"))
    by_source = by_shard.groupBy("source_key", "source").agg(
        F.sum("shard_size").alias("source_size"), F.sum("blocks").alias("source_blocks")
    )
    aimed = targets(by_source, weights, most_times).select(
        F.lit(0).alias("all"),
        "source_key",
        "source_size",
        "target",
        F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block_words).cast("bigint").alias("seats"),
        (F.col("source_blocks") * most_times).alias("most"),
    )
    quotas = written(
        sainte_lague(aimed, ["all"], "source_key", "target", "seats", "most").select(
            "source_key", "source_size", "target", F.col("quota").alias("seats")
        ),
        "mix-sources",
    )
    of_shards = by_shard.join(quotas, "source_key").withColumn("most", F.col("blocks") * most_times)
    rounds = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("bigint")
    start = F.when(
        F.col("blocks") > 0, _number(_seeded(F.lit(seed), "source_key", "shard")) % F.col("blocks")
    ).otherwise(0)
    dealt = (
        sainte_lague(of_shards, ["source_key"], "shard", "blocks", "seats", "most")
        .withColumn("rounds", rounds)
        .withColumn("extra", F.col("quota") - F.col("rounds") * F.col("blocks"))
        .withColumn("start", start)
        .select(
            "source_key",
            "shard",
            "source_size",
            "target",
            "rounds",
            (F.col("start") * block_words).alias("lo"),
            ((F.col("start") + F.col("extra")) * block_words).alias("hi"),
            ((F.col("start") + F.col("extra") - F.col("blocks")) * block_words).alias("wrapped"),
        )
    )
    line = Window.partitionBy("source_key", "shard").orderBy("digits", "doc_id", "size")
    laid = placed.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("end") - F.col("size")
    overlap = F.greatest(F.lit(0), F.least(F.col("end"), F.col("hi")) - F.greatest(begin, F.col("lo")))
    again = F.greatest(F.lit(0), F.least(F.col("end"), F.col("wrapped")) - begin)
    return laid.join(dealt, ["source_key", "shard"]).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("rounds") * F.col("size") + overlap + again).cast("bigint").alias("taken"),
    )
