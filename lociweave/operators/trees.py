"""Trees of few taxa from their pairwise distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: A request has no more taxa than this, so its distances fit the driver.
MOST_TAXA = 100


def neighbour_joining(distances: DataFrame, most: int = MOST_TAXA) -> str:
    """The unrooted neighbour-joining tree of distances (a, b, distance; each pair once), as a Newick text.

    Taxa are sorted by name, and of equally good pairs the first is joined, so the text does not depend on the order of
    rows. More than ``most`` taxa raise, as does a missing pair. One taxon is a leaf; none gives ``;``.
    """
    rows = distances.select("a", "b", "distance").limit(most * (most - 1) // 2 + 1).collect()
    names = sorted({n for r in rows for n in (r["a"], r["b"])})
    if len(names) > most:
        raise ValueError(f"more than {most} taxa")
    place = {n: i for i, n in enumerate(names)}
    d = np.full((len(names), len(names)), np.nan)
    np.fill_diagonal(d, 0.0)
    for a, b, x in rows:
        d[place[a], place[b]] = d[place[b], place[a]] = x
    if np.isnan(d).any():
        raise ValueError("a pair of taxa has no distance")
    labels = [str(n) for n in names]
    while len(labels) > 3:
        n, total = len(labels), d.sum(1)
        q = (n - 2) * d - total[:, None] - total
        q[np.tril_indices(n)] = np.inf
        i, j = np.unravel_index(int(np.argmin(np.round(q, 9))), q.shape)
        to_i = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        joined = (d[i] + d[j] - d[i, j]) / 2
        rest = [k for k in range(n) if k not in (i, j)]
        grown = np.zeros((n - 1, n - 1))
        grown[:-1, :-1] = d[np.ix_(rest, rest)]
        grown[-1, :-1] = grown[:-1, -1] = joined[rest]
        labels = [*(labels[k] for k in rest), f"({labels[i]}:{to_i:.5f},{labels[j]}:{d[i, j] - to_i:.5f})"]
        d = grown
    if len(labels) == 3:
        x = [(d[0, 1] + d[0, 2] - d[1, 2]) / 2, (d[0, 1] + d[1, 2] - d[0, 2]) / 2, (d[0, 2] + d[1, 2] - d[0, 1]) / 2]
        return "(" + ",".join(f"{name}:{length:.5f}" for name, length in zip(labels, x, strict=True)) + ");"
    return f"({labels[0]}:{d[0, 1] / 2:.5f},{labels[1]}:{d[0, 1] / 2:.5f});" if len(labels) == 2 else "".join(labels) + ";"
