"""Mixing sources to target weights by systematic sampling.

A source's expected copies per document are its target over its size. The
documents of a source stand in order of size; the expected copies are
summed along that order, one random offset per source is added, and a
document is emitted once for every integer that its step crosses. Standing
in order of size, the sample takes every size in proportion, so that the
words taken miss the target by less than the largest document.

Defined results: a null source is one source, standing last; a null or
empty text has size 0 and is taken as often as its source's rate says, at no
words; a source of size 0 has target 0 and rate 0; repeated rows are rows
like any other; an empty table gives an empty table. Other columns pass
through, whatever their names; those that `systematic_mix` adds replace any of
the same name.
The table of sources, one row each, is summed in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.llm.common import WORDS, fraction, fresh, joined_by_name, keyed, running_sum, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 42
ADDED = ("size", "source_size", "target", "copies", "taken")


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Targets of sources (_key, source, source_size): weights share the whole size, no target is above `most` sizes.

    Filling up: ordered by limit over weight, a source is full if the level
    at which all the later ones would stand is at or above its own limit.
    """
    ordered = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    limits = ordered.withColumn("_w", weight).withColumn("_limit", F.lit(float(most)) * F.col("source_size"))
    limits = limits.withColumn("_full_at", F.col("_limit") / F.col("_w"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("_full_at", "_n").rowsBetween(Window.unboundedPreceding, -1)
    levels = limits.withColumn(
        "_level",
        (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0)))
        / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))),
    )
    level = F.max(F.when(F.col("_level") < F.col("_full_at"), F.col("_level"))).over(everything)
    return levels.select(
        "_key",
        "source_size",
        F.least(F.col("_limit"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w")).alias("target"),
    )


def decisions(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: float = MOST_COPIES,
    seed: int = SEED,
    size: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The narrow part of the mix, a row for each of `df`: its columns `carry`, id, size (`size`, or else the words of `text`), source_size, target, copies and taken.

    The words are counted once and written with the id and the source; texts
    do not move.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))
    carried = [F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)]
    counted = (words_in(text) if size is None else size).cast("bigint")
    sized = written(df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), key.alias("_key"), counted.alias("size"), *carried), "sizes")
    ranked = running_sum(sized.withColumn("_one", F.lit(1)), "_key", [F.col("size"), F.col("id")], "_one", "_rank").drop("source")
    sizes = sized.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    offset = fraction(F.concat(F.lit(f"{seed}:"), F.col("_key")))
    step = lambda n: F.floor(F.col("_rate") * n.cast("double") + F.col("_offset"))
    return (
        ranked.join(targets, "_key")
        .withColumn("_rate", rate)
        .withColumn("_offset", offset)
        .withColumn("copies", (step(F.col("_rank") + 1) - step(F.col("_rank"))).cast("bigint"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*[F.col(f"carry{i}").alias(c) for i, c in enumerate(carry)], F.col("id").alias(id_col), *ADDED)
    )


def systematic_mix(df: DataFrame, **options) -> DataFrame:
    """Adds size, source_size, target, copies and taken to every row, in place of columns of these names. Options: those of `decisions`."""
    rows, names = keyed(df)
    decided = decisions(rows, **options, carry=names).select(*names, *ADDED)
    return joined_by_name(rows.drop(*ADDED), decided, names).drop(*names)


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The mixed table itself: every document as often as it is taken, with the input's columns. Only rows that are taken are joined and repeated."""
    rows, names = keyed(df)
    (copies,) = fresh(rows, "_copies")
    decided = decisions(rows, **options, carry=names).where("copies > 0").select(*names, F.sequence(F.lit(1), F.col("copies").cast("int")).alias(copies))
    taken = joined_by_name(rows, written(decided, "mix"), names)
    (number,) = fresh(taken, "_number")
    return taken.select(*df.columns, F.explode(copies).alias(number)).drop(number)
