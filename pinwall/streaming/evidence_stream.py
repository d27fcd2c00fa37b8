"""Evidence as a stream: the bounded fold as keyed state, and scan generations that make late results void."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from pinwall.operators import fold

_FIELDS = ("seq", "engine", "variant", "scope", "line_index", "text", "confidence")
_OUT = StructType([
    StructField("board_id", LongType()), StructField("note_id", LongType()), StructField("generation", LongType()), StructField("place", LongType()), StructField("seq", LongType()),
    StructField("engine", StringType()), StructField("variant", StringType()), StructField("scope", StringType()), StructField("line_index", IntegerType()), StructField("text", StringType()), StructField("confidence", LongType()),
])
_STATE = StructType([StructField("generation", LongType()), StructField("rows", StringType())])


def fold_stream(evidence: DataFrame) -> DataFrame:
    """The retained readings of each note after each micro-batch that touched it (update mode).

    State is a note's retained readings, at most four a reader and two a line and reader, and
    its newest scan generation; readings of older generations are dropped, a newer one starts
    afresh. Within a batch readings fold in order of generation and seq. This is no event-time
    watermark: a generation never expires by the clock.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        newest, rows = (state.get[0], json.loads(state.get[1])) if state.exists else (-1, [])
        batch = pd.concat(list(frames)).sort_values(["generation", "seq"], kind="stable")
        for r in batch.astype(object).where(batch.notna(), None).to_dict("records"):
            if r["generation"] < newest or not (r["text"] or "").strip():
                continue
            if r["generation"] > newest:
                newest, rows = r["generation"], []
            rows = fold.fold(rows, {c: int(r[c]) if c in ("seq", "confidence", "line_index") and r[c] is not None else r[c] for c in _FIELDS})
        state.update((int(newest), json.dumps(rows)))
        out = [{"board_id": key[0], "note_id": key[1], "generation": newest} | r for r in fold.as_rows(rows)]
        yield pd.DataFrame(out, columns=_OUT.names).astype({"line_index": "Int32"})

    return evidence.groupBy("board_id", "note_id").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def publish(stream: DataFrame, sink, checkpoint: str):
    """Starts the stream and hands each batch of changed notes to sink(frame, batch_id)."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
