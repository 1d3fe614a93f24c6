"""Left joins that multiply rows, made safe for keys with very many matches.

AQE splits a skewed left side of a left join but never its right side, so a key
with many right rows would be joined in one task.  Here the rows of such a key
are spread over slices, and the other side is repeated once per slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
# Below this the hot list is not known to be small, and is joined without a broadcast hint.
SURE_ROWS = 10_000


def hot_groups(df: DataFrame, key: str, group: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with over ``hot_rows`` rows in one group, with their largest group and one slice per ``hot_rows`` of its rows.

    At most count(df) / hot_rows rows, so the result can be broadcast: 10^11 rows
    give at most 10^5 keys.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key, group).agg(F.count("*").alias("_rows"))
    hot = counts.filter(F.col("_rows") > hot_rows)
    return hot.groupBy(key).agg(
        F.max_by(group, F.struct("_rows", group)).alias("_widest"), F.ceil(F.max("_rows") / hot_rows).cast("int").alias("_slices")
    )


def left_join_groups(
    base: DataFrame,
    base_key: str,
    facts: DataFrame,
    key: str,
    group: str,
    selections: dict[str, list],
    spread_by: str,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Left join ``base`` with one group of ``facts`` after the other, every match kept.

    ``selections`` maps a group value to the output columns taken from its rows.
    A base key with a hot group gets a copy per slice; the rows of its largest
    group are dealt out to them, those of its other groups go to each.  All joins
    share the key (base_key, slice), so every input is shuffled once.  With ``hot_rows``
    None no key is taken for hot, and inputs laid out by the key are joined where they lie.
    """
    if hot_rows is None:
        return _join_where_they_lie(base, base_key, facts, key, group, selections)
    wanted = facts.filter(F.col(group).isin(list(selections)))
    hot = hot_groups(wanted, key, group, hot_rows).withColumnRenamed(key, "_hot_key")
    if hot_rows >= SURE_ROWS:
        hot = F.broadcast(hot)
    every_slice = F.sequence(F.lit(0), F.col("_slices") - 1)

    copies = F.when(F.col("_widest").isNotNull(), every_slice).otherwise(F.array(F.lit(0)))
    out = base.join(hot, F.col(base_key) == F.col("_hot_key"), "left").select(
        *base.columns, "_widest", "_slices", F.explode(copies).alias("_slice")
    )
    rows = facts.join(hot, F.col(key) == F.col("_hot_key"), "left")
    dealt = F.pmod(F.xxhash64(spread_by), F.col("_slices")).cast("int")
    places = (
        F.when(F.col("_widest").isNull(), F.array(F.lit(0)))
        .when(F.col("_widest") == F.col(group), F.array(dealt))
        .otherwise(every_slice)
    )
    empty_slice, kept = F.lit(False), list(base.columns)
    for i, (value, columns) in enumerate(selections.items()):
        mark, at, place = f"_matched{i}", f"_key{i}", f"_place{i}"
        part = rows.filter((F.col(group) == value) & F.col(key).isNotNull()).select(
            F.col(key).alias(at), F.explode(places).alias(place), F.lit(True).alias(mark), *columns
        )
        out = out.join(part, (F.col(base_key) == F.col(at)) & (F.col("_slice") == F.col(place)), "left")
        kept += part.columns[3:]
        empty_slice = empty_slice | ((F.col("_widest") == value) & F.col(mark).isNull())
    # A slice of a hot key that got no row of the dealt group is no result row.
    return out.filter(~F.coalesce(empty_slice, F.lit(False))).select(*kept)


def _join_where_they_lie(base: DataFrame, base_key: str, facts: DataFrame, key: str, group: str, selections: dict[str, list]) -> DataFrame:
    out, kept = base, list(base.columns)
    for i, (value, columns) in enumerate(selections.items()):
        part = facts.filter((F.col(group) == value) & F.col(key).isNotNull()).select(F.col(key).alias(f"_key{i}"), *columns)
        out = out.join(part, F.col(base_key) == F.col(f"_key{i}"), "left")
        kept += part.columns[1:]
    return out.select(*kept)
