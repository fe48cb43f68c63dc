"""Token-budget packing as a stream: the buffer is state by shard, the query's checkpoint is the loader's snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "shard long, batch long, place long, sample_id long, length long"
STATE = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("batch", T.LongType())])


def packed_stream(samples: DataFrame, budget: int, buffer_size: int, idle_ms: int = 0) -> DataFrame:
    """samples: shard, sample_id, length (all long). Batches are emitted once the buffer holds buffer_size samples and budget tokens.

    With idle_ms, a shard that gets nothing for so long (processing time) is flushed: the end of the data, said explicitly.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from episodica.operators.batching import BudgetBuffer

        ids, lengths, batch = state.get if state.exists else ([], [], 0)
        buffer, out = BudgetBuffer(list(zip(ids, lengths, strict=True))), []

        def emit() -> None:
            nonlocal batch
            out.extend((key[0], batch, k, i, n) for k, (i, n) in enumerate(buffer.take(budget)))
            batch += 1

        if state.hasTimedOut:
            while buffer.items:
                emit()
        else:
            for pdf in pdfs:
                for i, n in pdf.sort_values("sample_id")[["sample_id", "length"]].itertuples(index=False):
                    buffer.add(int(i), int(n))
                    while buffer.ready(buffer_size, budget):
                        emit()
        state.update(([i for i, _ in buffer.items], [n for _, n in buffer.items], batch))
        if idle_ms and not state.hasTimedOut:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["shard", "batch", "place", "sample_id", "length"]).astype("int64")

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return samples.groupBy("shard").applyInPandasWithState(run, OUTPUT, STATE, "append", timeout)
