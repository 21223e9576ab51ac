"""Operators that are sequential by nature: each accepted candidate changes what follows.

They run per independent component or per key, as a stream of sorted rows, so the components run in parallel
and none has to fit in memory whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiling_path(df: DataFrame, key: str, identifier: str) -> DataFrame:
    """Minimal tiling of overlapping intervals: from the leftmost on, always the one that overlaps and reaches furthest.

    (key, identifier, step). A gap starts a new tiling; ties go to the earlier start, then the smaller identifier.
    """
    kinds = dict(df.dtypes)
    dealt = df.select(key, identifier, "start", "end").repartition(key).sortWithinPartitions(key, "start", F.col("end").desc(), identifier)

    def run(batches):
        now, step, reach, best = object(), 0, None, None  # best: furthest interval that overlaps the path so far
        for pdf in batches:
            out = []
            for k, i, s, e in pdf.itertuples(index=False):
                if k != now:
                    if best is not None:
                        out.append((now, best[1], step + 1))
                    now, step, reach, best = k, 1, e, None
                    out.append((k, i, 1))
                    continue
                if s > reach and best is not None:
                    step, reach = step + 1, best[0]
                    out.append((k, best[1], step))
                    best = None
                if s > reach:
                    step, reach = step + 1, e
                    out.append((k, i, step))
                elif e > reach and (best is None or e > best[0]):
                    best = (e, i)
            if out:
                yield pd.DataFrame(out, columns=[key, identifier, "step"])
        if best is not None:
            yield pd.DataFrame([(now, best[1], step + 1)], columns=[key, identifier, "step"])

    return dealt.mapInPandas(run, f"{key} {kinds[key]}, {identifier} {kinds[identifier]}, step int")


def longest_overlaps(pairs: DataFrame, left: str, right: str, most_overlap: int, most_trim: int) -> DataFrame:
    """``pairs`` and, for each trim of up to ``most_trim`` letters off the left end, the longest suffix of it that starts the right sequence."""

    @F.pandas_udf("array<int>")
    def overlaps(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        return pd.Series([_overlaps(a or "", b or "", most_overlap, most_trim) for a, b in zip(lefts, rights, strict=True)])

    return pairs.withColumn("overlaps", overlaps(left, right))


def _overlaps(left: str, right: str, most_overlap: int, most_trim: int) -> list[int]:
    head = right[:most_overlap]
    fail = [0] * (len(head) + 1)
    k = 0
    for i in range(1, len(head)):
        while k and head[i] != head[k]:
            k = fail[k]
        k += head[i] == head[k]
        fail[i + 1] = k
    matched, k = [], 0
    for c in left:
        while k and (k == len(head) or c != head[k]):
            k = fail[k]
        k += k < len(head) and c == head[k]
        matched.append(k)
    return [matched[len(left) - 1 - t] if t < len(left) else 0 for t in range(most_trim + 1)]


# The overlap of two contigs that may be merged without a donor, and how much of the left one's end may go.
LEAST_OVERLAP, MOST_OVERLAP, MOST_TRIM = 10_000, 500_000, 100


def merged_directly(gaps: DataFrame, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP, most_trim: int = MOST_TRIM) -> DataFrame:
    """Gaps (gap_start, gap_end, left_sequence, right_sequence) with trim_left, trim_right, edit_start and edit_end where the neighbours overlap exactly.

    A flush overlap wins if it is long enough; one that takes the whole right sequence rules a merge out. Otherwise the
    longest overlap after trimming the left end, of equal ones the least trimmed. All four are null where there is none.
    """
    tail = F.expr(f"right(left_sequence, {most + most_trim})")
    rows = longest_overlaps(gaps.withColumns({"__l": F.upper(tail), "__r": F.upper(F.substring("right_sequence", 1, most))}), "__l", "__r", most, most_trim)
    flush, size = F.get("overlaps", F.lit(0)), F.length("right_sequence")
    trims = F.transform("overlaps", lambda n, i: F.struct(n.alias("n"), (-i).alias("t")))
    best = F.array_max(F.filter(trims, lambda x: (x["t"] < 0) & (-x["t"] < F.length("left_sequence")) & (x["n"] >= least) & (x["n"] < size)))
    picked = F.when(flush >= size, F.lit(None)).when(flush >= least, F.struct(flush.alias("n"), F.lit(0).alias("t"))).otherwise(best)
    rows = rows.withColumn("__p", picked).withColumns({"trim_left": -F.col("__p.t"), "trim_right": F.col("__p.n")})
    return rows.withColumns({"edit_start": F.col("gap_start") - F.col("trim_left"), "edit_end": F.col("gap_end") + F.col("trim_right")}).drop("__l", "__r", "__p", "overlaps")
