"""Folding streamed chat pieces into messages: as a batch, and as a stateful stream."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOLDED = "conv string, index int, id string, type string, name string, arguments string, content string"
PIECE = "seq long, id string, type string, name string, arguments string, content string"


def fold(pieces: DataFrame) -> DataFrame:
    """One row per (conv, index) of pieces(conv, seq, index, id, type, name, arguments, content): id and type of the first
    piece, the last name, arguments and content joined in order."""
    p = F.struct("seq", "id", "type", "name", "arguments", "content")
    g = pieces.groupBy("conv", "index").agg(F.sort_array(F.collect_list(p)).alias("ps"))
    joined = lambda c: F.array_join(F.filter(F.transform("ps", lambda x: x[c]), lambda x: x.isNotNull()), "")
    names = F.filter(F.transform("ps", lambda x: x["name"]), lambda x: x.isNotNull())
    first = F.element_at("ps", 1)
    return g.select("conv", "index", first["id"].alias("id"), first["type"].alias("type"), F.try_element_at(names, F.lit(-1)).alias("name"), joined("arguments").alias("arguments"), joined("content").alias("content"))


class Fold(StatefulProcessor):
    """State of one message: its pieces, the seq of the one with the end mark, and when it is due if no more come. New pieces
    are appended to what is held, never written anew."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", PIECE)
        self.ends = handle.getValueState("ends", "seq long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, end, latest = [], None, None
        for f in rows:
            latest = max(x for x in (latest, f["at"].max()) if x is not None) if self.idle_ms is not None else None
            for r in f.itertuples(index=False):
                new.append((int(r.seq), *[x if isinstance(x, str) else None for x in (r.id, r.type, r.name, r.arguments, r.content)]))
                end = int(r.seq) if r.last is True or r.last == 1 else end
        if new:
            self.pieces.appendList(new)
        if end is not None:
            self.ends.update((end,))
        last = self.ends.get()
        if last is not None:
            held = self._held()
            if len(held) == last[0] + 1:
                yield self._folded(key, held)
                self._forget()
                return
        if self.idle_ms is not None and latest is not None:
            at = int(pd.Timestamp(latest).timestamp() * 1000) + self.idle_ms
            before = self.due.get()
            if before is None or before[0] < at:
                if before is not None:
                    self.handle.deleteTimer(before[0])
                self.handle.registerTimer(at)
                self.due.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held:
            yield self._folded(key, held)
        self.due.clear()  # the timer itself is gone
        self._forget()

    def close(self) -> None:
        pass

    def _held(self) -> list[tuple]:
        """The pieces in the order of seq, each once."""
        return sorted({r[0]: tuple(r) for r in self.pieces.get()}.values()) if self.pieces.exists() else []

    def _folded(self, key: tuple, held: list[tuple]) -> pd.DataFrame:
        names = [r[3] for r in held if r[3] is not None]
        text = lambda i: "".join(r[i] for r in held if r[i] is not None)
        row = [*key, held[0][1], held[0][2], names[-1] if names else None, text(4), text(5)]
        return pd.DataFrame([row], columns=["conv", "index", "id", "type", "name", "arguments", "content"])

    def _forget(self) -> None:
        before = self.due.get()
        if before is not None:
            self.handle.deleteTimer(before[0])
            self.due.clear()
        self.pieces.clear()
        self.ends.clear()


def fold_stream(pieces: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream of pieces(conv, seq, index, id, type, name, arguments, content, last), seq from 0 without gaps:
    a message is put out once all pieces up to the one with the end mark `last` have come, in whatever order, repeated ones
    counting once. With idle_ms the stream has event times `at` and a watermark on them: a message is also put out, as far as
    it has come, when the watermark passes its latest piece by so much. Then its state is gone; pieces that come later begin
    it anew. Queries need the state store of rocks_db().
    """
    mode = "None" if idle_ms is None else "EventTime"
    return pieces.groupBy("conv", "index").transformWithStateInPandas(Fold(idle_ms), FOLDED, "append", mode)


@contextlib.contextmanager
def rocks_db(spark: SparkSession):
    """Streaming queries started inside keep their state in RocksDB, which states of several variables and timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
