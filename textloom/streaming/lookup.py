"""Streams: lookup of a stream of words in a static index, and a keyed recency filter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import delete_variants
from textloom.operators.filters import recent_hits


def lookup_batch(index: DataFrame, sink, k: int = 2):
    """A function for foreachBatch: each micro-batch's distinct words are looked up, and sink gets (hits, batch id)."""
    from textloom.operators.matching import lookup_top

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(lookup_top(batch.select("query").distinct(), index, k), batch_id)

    return run


def candidates_stream(queries: DataFrame, index: DataFrame, k: int = 2) -> DataFrame:
    """A stream of (query, word, distances) by stream-static join; no state."""
    from textloom.operators.matching import on_edit

    v = queries.select("query", F.explode(delete_variants("query", k)).alias("v")).select("query", "v.edit", "v.d", "v.code")
    distance = F.char_length("word") - F.char_length("edit")
    return on_edit(v, index).where((F.abs(F.char_length("word") - F.char_length("query")) <= k) & (distance <= k)).select("query", "word", "count", distance.alias("edit_distance"), F.col("d").alias("delete_distance"), "code")


def lru_stream(events: DataFrame, by: str, key: str, order: str, capacity: int) -> DataFrame:
    """A stream of (by, order, key, hit); each group's recent keys are kept as state, at most `capacity` of them."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = dict.fromkeys(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values([order, key], kind="stable")  # a group comes in several pieces of its batch
        yield rows[[by, order, key]].assign(hit=recent_hits(rows[key].tolist(), recent, capacity))
        state.update((list(recent),))

    kind = lambda c: events.schema[c].dataType.simpleString()
    out = f"{by} {kind(by)}, {order} {kind(order)}, {key} {kind(key)}, hit boolean"
    return events.select(by, order, key).groupBy(by).applyInPandasWithState(step, out, f"recent array<{kind(key)}>", "append", "NoTimeout")

