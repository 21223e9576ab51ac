"""Window-shaped operators: numbering, best rows, running positions, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark stops each group early by its window group limit."""
    return numbered(df, keys, order, "__n").filter(F.col("__n") <= n).drop("__n")


def best_struct(df: DataFrame, keys: list[str], ascending: list[Column], columns: list[str]) -> DataFrame:
    """The least row of each key by a struct of sort values: a partial aggregate, no sort. Values must be ascending (negate numbers)."""
    return df.groupBy(*keys).agg(F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ascending)], *[F.col(c) for c in columns])).alias("b")).select(*keys, *[F.col(f"b.{c}") for c in columns])


def running_positions(df: DataFrame, keys: list[str], order: list, length: str) -> DataFrame:
    """1-based start and end of each piece laid end to end."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("end", F.sum(length).over(run)).withColumn("start", F.col("end") - F.col(length) + 1)


def neighbour_classes(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Relation to the interval before: first, overlap, adjacent or gap, and by how much."""
    before = F.lag("end").over(Window.partitionBy(*keys).orderBy(*order))
    distance = F.col("start") - before - 1
    relation = F.when(before.isNull(), "first").when(distance < 0, "overlap").when(distance == 0, "adjacent").otherwise("gap")
    return df.withColumns({"relation": relation, "bp": F.coalesce(F.abs(distance), F.lit(0))})


def cigar_walk(df: DataFrame, keys: list[str], order: list, op: str = "op", length: str = "length") -> DataFrame:
    """Query and reference positions after each operation: M, X and = move both, I the query, D and N the reference."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    moves = lambda ops: F.sum(F.when(F.col(op).isin(*ops), F.col(length)).otherwise(0)).over(run)
    return df.withColumns({"query_pos": moves("MX=I"), "ref_pos": moves("MX=DN")})


def flanking(df: DataFrame, keys: list[str], order: list, is_anchor: Column, is_target: Column, id_col: str) -> DataFrame:
    """Each target with its two nearest anchors on either side (before_1, before_2, after_1, after_2).

    The anchors carry their own predecessor along, so one window pass in each direction replaces a join of
    targets and anchors and a ranking of its result.
    """
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    on_anchors = Window.partitionBy(*keys, "__anchor")
    marked = df.withColumn("__anchor", is_anchor)
    chained = marked.withColumns({
        "__up": F.struct(F.col(id_col).alias("one"), F.lag(id_col).over(on_anchors.orderBy(*order)).alias("two")),
        "__down": F.struct(F.col(id_col).alias("one"), F.lead(id_col).over(on_anchors.orderBy(*order)).alias("two")),
    })
    last = lambda c, w: F.last(F.when(F.col("__anchor"), F.col(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = chained.withColumns({"__b": last("__up", up), "__a": last("__down", down)}).filter(is_target)
    return seen.select(*df.columns, F.col("__b.one").alias("before_1"), F.col("__b.two").alias("before_2"), F.col("__a.one").alias("after_1"), F.col("__a.two").alias("after_2"))


def orientation_runs(df: DataFrame, keys: list[str], order: list, flips: Column) -> DataFrame:
    """Orientation carried along: every flip turns all that follow."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("orientation", F.when(F.sum(flips.cast("int")).over(run) % 2 == 0, "+").otherwise("-"))


def placed_then_unplaced(df: DataFrame, keys: list[str], placed: Column, order: list) -> DataFrame:
    """Placed rows 1..n; unplaced ones count down from the total."""
    rank = F.row_number().over(Window.partitionBy(*keys, "__placed").orderBy(*order))
    total = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__placed", placed).withColumn("n", F.when(F.col("__placed"), rank).otherwise(total - rank + 1)).drop("__placed")


def disambiguated(df: DataFrame, name: str, scope: str) -> DataFrame:
    """Names that stand in several scopes get the scope appended."""
    both = Window.partitionBy(name)
    many = F.min(scope).over(both) != F.max(scope).over(both)
    return df.withColumn("display_name", F.when(many, F.concat_ws("@", name, scope)).otherwise(F.col(name)))


def fifo_pairs(top: DataFrame, bottom: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The n-th row of one side with the n-th of the other, per key."""
    return numbered(top, keys, order, "rn").join(numbered(bottom, keys, order, "rn"), [*keys, "rn"])


def shifted_orders(df: DataFrame, position: Column, by: int = 1) -> Column:
    """Orders after a break point move on."""
    return F.when(F.col("order") > position, F.col("order") + by).otherwise(F.col("order"))
