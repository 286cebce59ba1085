"""Top-k over a stream of weighted edges: the K best two-step paths after each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.jointree import line
from ..plans.topk import product_k


def ranked_batches(edges: DataFrame, history: Callable[[], DataFrame], k: int, sink: Callable[[DataFrame, int], None], n: int = 2) -> StreamingQuery:
    """Starts a query that, for each batch of ``edges``, hands ``sink`` the k best n-step paths over ``history()``, which the caller keeps up to date."""

    def each(batch: DataFrame, number: int) -> None:
        sink(product_k(line(history().unionByName(batch), n), k), number)

    return edges.writeStream.foreachBatch(each).start()
