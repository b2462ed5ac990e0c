"""Joins and lists that stay balanced when a few keys own most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgate.session import stage

# Keys with more than one row in HEAVY_SHARE take the broadcast path; there can't be more than HEAVY_SHARE of them.
# No key that is left holds more, so the shuffle below stays balanced.
HEAVY_SHARE = 2_000
HEAVY_ROWS = 10_000
SPREAD = 2048
# Rows from sources of this size fit one task even if they all share a key; they are joined as they are.
SMALL_BYTES = 64 << 20


def source_bytes(df: DataFrame) -> int:
    """What the planner knows of the size of all tables that the rows come from."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(sizes)


def broadcast_bytes(spark: SparkSession) -> int:
    """Up to which size the planner sends a table to all tasks."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def attach(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str],
    weight: str,
    spread_by: list[str],
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Left join a table with one row per key onto rows whose keys may be badly skewed.

    ``weight`` names the column of ``facts`` with the number of rows per key. ``facts`` is stored
    first: it is computed once, and its size is known to the planner. When some keys are heavy, the
    heaviest (a bounded number) are joined by broadcast and their rows travel through the shuffle
    under a salt, so that no task receives a whole heavy key; otherwise the join is left to the
    planner. All other columns of ``facts`` are added. Rows from small sources, and all rows when
    ``facts`` is small enough for the planner to broadcast, are joined without a look for heavy keys; the result is the same
    either way.
    """
    values = [c for c in facts.columns if c not in keys]
    packed = stage(
        facts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*values).alias("_fact")), "facts"
    )
    small = source_bytes(packed) <= broadcast_bytes(packed.sparkSession)  # then no row moves, however heavy its key is
    if heavy_rows >= HEAVY_ROWS and (small or source_bytes(rows) <= SMALL_BYTES):
        joined = rows.join(packed, _all_equal(keys), "left")
        return joined.select(*rows.columns, *[F.col(f"_fact.{v}").alias(v) for v in values])
    total = packed.agg(F.sum(f"_fact.{weight}")).first()[0] or 0
    heavy = packed.filter(
        (F.col(f"_fact.{weight}") >= heavy_rows) & (F.col(f"_fact.{weight}") * HEAVY_SHARE > total)
    ).withColumnRenamed("_fact", "_heavy")
    matches = _all_equal(keys)
    if heavy.isEmpty():
        joined = rows.join(packed, matches, "left")
        return joined.select(*rows.columns, *[F.col(f"_fact.{v}").alias(v) for v in values])
    marked = rows.join(F.broadcast(heavy), matches, "left").drop(*[f"_k_{k}" for k in keys])
    salt = F.when(
        F.col("_heavy").isNotNull(), F.lit(1) + F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD))
    ).otherwise(F.lit(0).cast("bigint"))
    light = packed.withColumn("_unsalted", F.lit(0).cast("bigint"))
    joined = marked.withColumn("_salt", salt).join(
        light, matches & (F.col("_salt") == F.col("_unsalted")), "left"
    )
    fact = F.coalesce(F.col("_heavy"), F.col("_fact"))
    return joined.select(*rows.columns, *[fact[v].alias(v) for v in values])


def _all_equal(keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"_k_{key}"))
    return condition


def counted(rows: DataFrame, keys: list[str], at_least: int = 1, name: str = "n_rows") -> DataFrame:
    """Rows per key; the partial counts are made before the shuffle."""
    per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return per_key.filter(F.col(name) >= at_least) if at_least > 1 else per_key
