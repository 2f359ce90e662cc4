"""Keys: uniqueness checks, upserts and set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """The same rows; the job fails if a key occurs twice.

    One hash aggregate on the keys, whose partitioning a join on the same keys
    then reuses.
    """
    others = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others]
    )
    fail = F.raise_error(F.lit(f"duplicate key ({', '.join(keys)}) in {what}"))
    return counted.filter(F.when(F.col("_n") > 1, fail.cast("boolean")).otherwise(True)).select(*df.columns)


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fails on a duplicate key on either side."""
    return assert_unique(left, keys, "left side").join(
        assert_unique(right, keys, "right side"), list(keys), "left"
    )


def upsert(stored: DataFrame | None, new: DataFrame, keys: Sequence[str], precedence: Sequence[Column]) -> DataFrame:
    """Union of both, one row per key: the one whose precedence is greatest.

    An aggregate rather than a ranking window, so that copies of a hot key
    shrink to one row before the shuffle. End the precedence with a column that
    settles ties.
    """
    rows = new if stored is None else stored.unionByName(new, allowMissingColumns=True)
    kept = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*precedence)).alias("_row")
    )
    return kept.select("_row.*")


def first_seen(stored: DataFrame | None, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows to append: of each key not stored yet, the earliest new one.

    The new side is reduced to one row per key before it meets the store.
    """
    earliest = new.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in new.columns]), F.col(order)).alias("_row")
    ).select("_row.*")
    return earliest if stored is None else missing_from(earliest, stored, keys)


def missing_from(rows: DataFrame, stored: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows whose key the stored table lacks."""
    if not null_safe:
        return rows.join(stored.select(*keys), list(keys), "left_anti")
    known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return rows.join(known, condition, "left_anti")


def last_reading(stored: DataFrame | None, new: DataFrame, keys: Sequence[str], seen_at: str = "scraped_at") -> DataFrame:
    """Upsert in which the latest reading of a key wins, and then the new one."""
    ranked = None if stored is None else stored.withColumn("_new", F.lit(0))
    merged = upsert(ranked, new.withColumn("_new", F.lit(1)), keys, [F.col(seen_at), F.col("_new")])
    return merged.drop("_new")


def by_source(stored: DataFrame | None, new: DataFrame, keys: Sequence[str], ranks: dict[str, int],
              sequence: str | None = None) -> DataFrame:
    """Upsert in which the better source of a key wins, and then the newer row."""
    pairs = [F.lit(part) for pair in ranks.items() for part in pair]
    rank = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0))
    ranked = None if stored is None else stored.withColumn("_new", F.lit(0))
    order = [rank, F.col("_new")] + ([F.col(sequence)] if sequence else [])
    return upsert(ranked, new.withColumn("_new", F.lit(1)), keys, order).drop("_new")


def stack(*parts: DataFrame) -> DataFrame:
    """Union by column name; columns a part lacks become NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
