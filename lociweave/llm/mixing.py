"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1 (as
they are). The exponent is found by multi-way bisection: every pass is one aggregate over the table of
sources that evaluates a whole grid of exponents, so the sources are never gathered on the driver.
Targets are a least entropy of the weights, or a limit on how often the text of any source may repeat.

The weights become a plan per source: so many whole epochs and a part of one more. Within an epoch,
documents stand in blocks, the blocks are permuted by a keyed hash, and the documents within a block
likewise. The part takes whole blocks, then documents of the block in which the budget ends. A source
has a fixed number of blocks, so summing them up in order takes one small window, and the window over
documents sees one block of each source only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.runtime import drop_stored, store

BLOCKS = 1024
GRID = 32


def token_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _statistics(shares: DataFrame, grid: list[float]):
    """For each exponent: the weights' entropy, and the most repeats if the source with most tokens is read once."""
    top = F.max("share")
    logs = [F.sum(F.pow("share", F.lit(a))).alias(f"z{i}") for i, a in enumerate(grid)] + [F.sum(F.pow("share", F.lit(a)) * F.log("share")).alias(f"y{i}") for i, a in enumerate(grid)]
    row = shares.agg(top.alias("top"), F.min("share").alias("low"), *logs).first()
    if row["top"] is None:
        return None
    from math import log

    return [(log(row[f"z{i}"]) - a * row[f"y{i}"] / row[f"z{i}"], (row["low"] / row["top"]) ** (a - 1)) for i, a in enumerate(grid)]


def solve_exponent(shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, digits: int = 6) -> float:
    """The largest exponent whose weights have ``target_entropy`` (nats), or the least at which no source repeats more than ``max_repeats`` times.

    ``shares`` has a column share, all positive. With both targets, the limit on repeats wins. Targets out of
    reach give the nearest end of [0, 1]; no target, or no source, gives 1.
    """
    low, high = 0.0, 1.0
    if target_entropy is None and max_repeats is None:
        return 1.0
    while high - low > 10.0 ** -(digits + 1):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        stats = _statistics(shares, grid)
        if stats is None:
            return 1.0
        if max_repeats is not None:
            enough = [r <= max_repeats for _, r in stats]  # true from some exponent on
            need = next((i for i, ok in enumerate(enough) if ok), GRID)
            floor = grid[need]
            if target_entropy is not None and stats[need][0] > target_entropy:
                return solve_exponent(shares, target_entropy, None, digits)
            low, high = (floor, floor) if need == 0 else (grid[need - 1], floor)
        else:
            least = max((i for i, (h, _) in enumerate(stats) if h >= target_entropy), default=0)
            low, high = (grid[least], grid[least]) if least in (0, GRID) and (least == GRID or stats[0][0] < target_entropy) else (grid[least], grid[min(least + 1, GRID)])
    return round(high if max_repeats is not None else low, digits)


def _keys(seed: int, epoch: Column, source: Column, block: Column, doc: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(seed), epoch, source, block), F.xxhash64(F.lit(seed), epoch, doc, F.lit("doc"))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 1.25, budget_tokens: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs``, each row as often as the weights say, with epoch, block, block_key, doc_key, exponent and weight.

    Sorted by (epoch, block_key, doc_key) within a source the rows are that source's permuted stream. Without
    ``budget_tokens`` the budget is the least at which every source is read at least once, so no document
    goes. With one, no source exceeds its weight times the budget. A null source is a source of its own;
    texts without words weigh nothing and go with their block; equal ids go together; rows that repeat count
    as often as they stand. A table without any word comes back once. Any other columns, of any names, pass
    through; where one is named like a new column, the new one is ``mix_`` and its name.
    """
    names = ("epoch", "block", "block_key", "doc_key", "exponent", "weight")
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    held = docs.toDF(*own.values())
    id_col, source_col, text_col = own[id_col], own[source_col], own[text_col]
    source, doc = F.col(source_col), F.coalesce(F.col(id_col).cast("string"), F.lit("\0"))
    block = F.pmod(F.xxhash64(F.lit(seed), doc), F.lit(BLOCKS)).cast("int")
    small = store(held.select(source.alias("source"), doc.alias("doc"), block.alias("block"), token_count(F.col(text_col)).alias("tokens")), "mix-docs")
    sums = store(small.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sources = sums.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.filter("tokens > 0").select("source", "tokens", (F.col("tokens") / total).alias("share")) if total else sources.filter("false").withColumn("share", F.lit(1.0))
    exponent = solve_exponent(shares, target_entropy, max_repeats)
    z, most = shares.agg(F.sum(F.pow("share", F.lit(exponent))), F.max(F.pow("share", F.lit(1 - exponent)))).first() if total else (1.0, 1.0)
    weight = F.pow("share", F.lit(exponent)) / z
    wanted = weight * budget_tokens if budget_tokens is not None else F.col("tokens") * F.pow("share", F.lit(exponent - 1)) * most
    plan = shares.select("source", "tokens", weight.alias("weight"), F.round(wanted, 3).alias("wanted")).withColumn("epochs", F.floor(F.col("wanted") / F.col("tokens") + 1e-9)).withColumn("rest", F.floor(F.greatest(F.lit(0.0), F.col("wanted") - F.col("epochs") * F.col("tokens"))).cast("long"))

    # Where the last, partial epoch of each source ends: block by block, then document by document.
    last = F.col("epochs").cast("long") + 1
    p = plan.select(F.col("source").alias("p_source"), "epochs", "rest", "weight")
    block_key, doc_key = _keys(seed, last, F.col("source"), F.col("block"), F.col("doc"))
    over_blocks = Window.partitionBy("source").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, 0)
    stops = sums.join(p, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block_key", block_key).withColumn("upto", F.sum("tokens").over(over_blocks))
    stops = stops.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("tokens") <= F.col("rest")) & (F.col("tokens") > 0)).select("p_source", F.col("block").alias("stop_block"), "block_key", "epochs", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))
    inside = small.join(stops.select("p_source", "stop_block", "epochs", "left"), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("stop_block"))).withColumn("doc_key", doc_key)
    over_docs = Window.partitionBy("p_source").orderBy("doc_key").rowsBetween(Window.unboundedPreceding, 0)
    ends = inside.groupBy("p_source", "left", "doc_key").agg(F.sum("tokens").alias("tokens")).withColumn("upto", F.sum("tokens").over(over_docs)).filter(F.col("upto") <= F.col("left")).groupBy("p_source").agg(F.max("doc_key").alias("stop_doc_key"))
    ends = ends.withColumnRenamed("p_source", "e_source")
    stops = stops.select(F.col("p_source").alias("s_source"), F.col("block_key").alias("stop_block_key"), "stop_block")
    plan = store(plan.join(stops, F.col("source").eqNullSafe(F.col("s_source")), "left").join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").select(F.col("source").alias("p_source"), "weight", "epochs", "stop_block_key", "stop_block", "stop_doc_key"), "mix-plan")
    for done in (small, sums):
        drop_stored(done)

    joined = held.withColumns({"__doc": doc, "block": block}).join(plan, source.eqNullSafe(F.col("p_source")), "left")
    last = F.coalesce("epochs", F.lit(1)).cast("long") + 1
    block_key, doc_key = _keys(seed, last, source, F.col("block"), F.col("__doc"))
    before = (block_key < F.col("stop_block_key")) | ((block_key == F.col("stop_block_key")) & (F.col("block") < F.col("stop_block")))
    at = (F.col("block") == F.col("stop_block")) & F.coalesce(doc_key <= F.col("stop_doc_key"), F.lit(False))
    times = F.coalesce("epochs", F.lit(1)).cast("long") + F.when(F.coalesce(before | at, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    rows = joined.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times))))
    block_key, doc_key = _keys(seed, F.col("epoch"), source, F.col("block"), F.col("__doc"))
    rows = rows.withColumns({"block_key": block_key, "doc_key": doc_key, "exponent": F.lit(float(exponent))})
    kept = [F.col(inner).alias(c) for c, inner in own.items()]
    return rows.select(*kept, *(F.col(n).alias(f"mix_{n}" if n in own else n) for n in names))


def op8_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).drop("text")
