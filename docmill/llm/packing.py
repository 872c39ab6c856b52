"""Filling containers of fixed capacity with texts sized in tokens, by bounded-space online best-fit packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.bpe import DEFAULT_VOCABULARY, share_vocabulary, worker_encoder

CAPACITY = 2048
#: Windows kept open in a task, and first-pass tasks whose leftovers one second-pass group takes: these bound memory.
OPEN_WINDOWS = 128
FAN_IN = 32
#: Number, within its task, of the container of texts without tokens; it never fills, so they needn't be held until it does.
EMPTY = 1 << 35
#: Windows of the second pass are numbered from here on.
SECOND_PASS = 1 << 62


class WindowPacker:
    """Best-fit into a fixed number of open windows; when nothing fits and all are open, the fullest is emitted."""

    def __init__(self, capacity: int, windows: int) -> None:
        self.capacity, self.windows = capacity, windows
        self.room: list[tuple[int, int]] = []  # (free tokens, window), sorted
        self.items: dict[int, list[tuple]] = {}
        self.opened = 0

    def add(self, item: tuple, size: int) -> list[tuple[int, list[tuple]]]:
        """Place item; returns the windows this emits, each as (number, items)."""
        out = []
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if len(self.room) >= self.windows:
                _, fullest = self.room.pop(0)
                out.append((fullest, self.items.pop(fullest)))
            free, window = self.capacity, self.opened
            self.opened += 1
            self.items[window] = []
        held = self.items[window]
        held.append(item)
        if free == size:
            out.append((window, self.items.pop(window)))
        else:
            insort(self.room, (free - size, window))
        return out

    def rest(self) -> list[tuple[int, list[tuple]]]:
        """The windows still open, which are then gone."""
        out = sorted(self.items.items())
        self.room, self.items = [], {}
        return out


def cut_oversized(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(first token, size) of each piece: one unless the text alone is larger than a container."""
    if n_tokens <= capacity:
        return [(0, n_tokens)]
    return [(at, min(capacity, n_tokens - at)) for at in range(0, n_tokens, capacity)]


def _rows(key_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("key", key_type), ("piece", pa.int32()), ("first_token", pa.int32()), ("n_tokens", pa.int32()),
            ("container_id", pa.int64()), ("slot", pa.int32()), ("used", pa.int32()), ("spread", pa.int64()),
        ]
    )


class _Out:
    """Rows on their way out, in batches."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.cols = schema, [[] for _ in schema]

    def window(self, number: int | None, items: list[tuple], spread: int, slot_from: int = 0) -> None:
        used = sum(x[3] for x in items)
        for slot, (key, piece, first, size) in enumerate(items, slot_from):
            row = (key, piece, first, size, number, slot, used, spread)
            for col, value in zip(self.cols, row):
                col.append(value)

    def batch(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.cols[0]) >= least:
            cols, self.cols = self.cols, [[] for _ in self.schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema)], schema=self.schema)


def pack_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN, vocabulary: str = DEFAULT_VOCABULARY,
) -> DataFrame:
    """(id, piece, first_token, n_tokens, container_id, slot, used): each text assigned to a container, whole unless
    it alone exceeds the capacity; then it is cut every `capacity` tokens, all pieces but the last filling a container.

    Null and empty texts have no tokens and take a slot of size 0, in a container of their task's. Repeated rows are packed one by one. Other columns
    of df are not read. Texts are sized and packed in the tasks of the scan; only the rows of the assignment, a few
    numbers each, are shuffled, so that the leftovers of `fan_in` tasks (bounded by the open windows) are packed
    again together, largest first. The result is the same if a task is run again.
    """
    if capacity < 1 or windows < 1 or fan_in < 1:
        raise ValueError("capacity, windows and fan_in must be positive")
    shared = share_vocabulary(df.sparkSession, vocabulary)
    src = df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("body"))
    key_type = src.schema["key"].dataType.simpleString()
    ddl = f"key {key_type}, piece int, first_token int, n_tokens int, container_id bigint, slot int, used int, spread bigint"

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = worker_encoder(shared), TaskContext.get().partitionId()
        packer, out, empty = WindowPacker(capacity, windows), None, 0
        for batch in batches:
            out = out or _Out(_rows(batch.schema.field(0).type))
            for key, size in zip(batch.column(0).to_pylist(), encoder.counts(batch.column(1).to_pylist())):
                if not size:
                    out.window((task << 36) + EMPTY, [(key, 0, 0, 0)], empty, empty)
                    empty += 1
                    continue
                for piece, (first, n) in enumerate(cut_oversized(size, capacity)):
                    for number, items in packer.add((key, piece, first, n), n):
                        out.window((task << 36) + number, items, number)
            yield from out.batch(10_000)
        if out:
            for _, items in packer.rest():
                out.window(None, items, -1 - task // fan_in)
            yield from out.batch()

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, out = defaultdict(list), None
        for batch in batches:
            out = out or _Out(batch.schema)
            is_done = batch.column(4).is_valid()
            yield batch.filter(is_done)
            for row in batch.filter(pa.compute.invert(is_done)).to_pylist():
                left[row["spread"]].append((row["key"], row["piece"], row["first_token"], row["n_tokens"]))
        for group, items in sorted(left.items()):
            packer = WindowPacker(capacity, len(items) + 1)
            base = SECOND_PASS + ((-1 - group) << 36)
            for item in sorted(items, key=lambda x: (-x[3], str(x[0]), x[1])):
                for number, held in packer.add(item, item[3]):
                    out.window(base + number, held, group)
            for number, held in packer.rest():
                out.window(base + number, held, group)
            yield from out.batch(10_000)
        if out:
            yield from out.batch()

    packed = src.mapInArrow(first_pass, ddl).repartition("spread").mapInArrow(second_pass, ddl)
    return packed.drop("spread").withColumnRenamed("key", id_col)
