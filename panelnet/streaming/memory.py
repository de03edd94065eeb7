"""Graph memory over a stream of monthly edges: an edge's state is its remembered weight."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "t int, src long, dst long, w double"


def stream_memory(edges: DataFrame, alpha: float) -> DataFrame:
    """edges(t, src, dst, w), streamed in order of t -> the memory of each edge at the months in which it is seen.

    M_0 = W_0 and M_t = alpha W_t + (1 - alpha) M_(t-1); months in which an edge is missing count as weight 0.
    State is two numbers an edge. A month that comes late for its edge is dropped.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, memory = state.get if state.exists else (-1, 0.0)
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, w in zip(rows.t, rows.w):
            if t <= last:
                continue
            gap = 0 if last < 0 else t - last - 1
            memory = float(w) if t == 0 else alpha * float(w) + (1 - alpha) * (memory * (1 - alpha) ** gap if last >= 0 else 0.0)
            last = int(t)
            out.append((last, key[0], key[1], memory))
        state.update((last, memory))
        yield pd.DataFrame(out, columns=["t", "src", "dst", "w"])

    return edges.groupBy("src", "dst").applyInPandasWithState(update, OUT, "t int, w double", "append", "NoTimeout")
