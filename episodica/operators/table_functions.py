"""Table functions for SQL: one row to many examples, and greedy packing of a partition in order.

    register(spark)
    select doc_id, c.* from documents, lateral text_pieces(octet_length(text), 512) as c
    select * from pack_by_budget(table(select source, doc_id, n_chars from documents) partition by (source) order by (doc_id), 4000, 20)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from episodica.shipping import ship_package


class TextPieces:
    """The pieces of a text of so many ids with an end id after them: number and size. A null text has none."""

    def eval(self, n: int, size: int) -> Iterator[tuple[int, int]]:
        for k, at in enumerate(range(0, n + 1, size) if n is not None else ()):
            yield k, min(size, n + 1 - at)


class PackByBudget:
    """Greedy batches of a partition's rows (key, id, length), taken in their order: see batching.packed_by_budget. A buffer is all that is held."""

    def __init__(self) -> None:
        from episodica.operators.batching import BudgetBuffer

        self.buffer, self.batch, self.key, self.budget = BudgetBuffer(), 0, None, 0

    def _emit(self) -> Iterator[tuple]:
        taken = self.buffer.take(self.budget)
        yield from ((self.key, self.batch, place, i, n) for place, (i, n) in enumerate(taken))
        self.batch += 1

    def eval(self, row: Row, budget: int, buffer_size: int) -> Iterator[tuple]:
        self.key, self.budget = row[0], budget
        self.buffer.add(row[1], row[2] or 0)
        while self.buffer.ready(buffer_size, budget):
            yield from self._emit()

    def terminate(self) -> Iterator[tuple]:
        while self.buffer.items:
            yield from self._emit()


def register(spark: SparkSession) -> None:
    """Makes text_pieces and pack_by_budget known to the session's SQL."""
    ship_package(spark)
    spark.udtf.register("text_pieces", udtf(TextPieces, returnType="chunk long, n long"))
    spark.udtf.register("pack_by_budget", udtf(PackByBudget, returnType="key string, batch long, place long, id long, length long"))
