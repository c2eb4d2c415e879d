"""Hierarchical multi-length packing.

A document's ids are cut into full windows of the longest tier; what is left is routed to the smallest tier that
holds it. A left-over of the longest tier opens a window whose gap is filled from the shorter tiers, longest first,
the last piece cut to fit. What the gaps leave is packed tier by tier into full windows of that tier, and the very
last pieces of a task into windows whose lengths are powers of two, so that no window needs padding. Step groups
take windows in this order until a fixed number of tokens is full, which balances them: a group holds that number,
give or take less than one longest window, but for the last group of each task, which may hold less.

Every task packs the rows that it reads, with no shuffle, and holds a bounded number of open pieces: pools beyond
`POOL` pieces are packed at once. A retried task gives the same pieces if it reads the same rows in the same order, as
scans of files do; rows that come from a shuffle have no such order and are to be written first (`common.staged`).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import small_batches
from tidelake.llm.tokens import encoder

#: Context sizes in tokens (powers of two, ascending), pieces that a task keeps for gaps, tokens of a step group.
TIERS, POOL, STEP_TOKENS = (256, 512, 1024), 512, 16 * 1024
#: Window numbers of one task: 2 ** 40 of them, under its partition number.
NUMBERS = 40


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    of: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.of), Piece(self.doc, self.start + n, self.ids[n:], self.of)


@dataclass
class Packer:
    """Packs one task's documents; take() gives the windows that are complete."""

    tiers: tuple[int, ...] = TIERS
    pool: int = POOL
    pools: dict[int, deque[Piece]] = field(default_factory=dict)
    done: list[tuple[int, list[Piece]]] = field(default_factory=list)

    def __post_init__(self):
        if any(t & (t - 1) for t in self.tiers) or list(self.tiers) != sorted(set(self.tiers)):
            raise ValueError("tiers are ascending powers of two")
        self.pools = {t: deque() for t in self.tiers}

    def add(self, doc: object, ids: np.ndarray) -> None:
        most, of = self.tiers[-1], len(ids)
        whole = of - of % most
        for at in range(0, whole, most):
            self.done.append((most, [Piece(doc, at, ids[at : at + most], of)]))
        if whole < of:
            self.route(Piece(doc, whole, ids[whole:], of))
        for tier in self.tiers:
            if len(self.pools[tier]) > self.pool:
                self.pack(tier)

    def route(self, piece: Piece) -> None:
        self.pools[next(t for t in self.tiers if len(piece.ids) <= t)].append(piece)

    def fill(self, window: list[Piece], gap: int, tiers: tuple[int, ...]) -> int:
        """Puts pieces of the tiers, longest first, into the gap; the last is cut. What gap is left."""
        for tier in reversed(tiers):
            pool = self.pools[tier]
            while gap and pool:
                piece = pool.popleft()
                if len(piece.ids) > gap:
                    piece, rest = piece.cut(gap)
                    self.route(rest)
                window.append(piece)
                gap -= len(piece.ids)
        return gap

    def pack(self, tier: int) -> None:
        """Full windows from a tier's pieces, their gaps filled from shorter tiers first, then from its own."""
        pool, shorter = self.pools[tier], tuple(t for t in self.tiers if t < tier)
        while pool:
            window = [pool.popleft()]
            gap = self.fill(window, tier - len(window[0].ids), shorter)
            gap = self.fill(window, gap, (tier,))
            if gap:  # not enough for a full window: kept for the next rows
                pool.extendleft(reversed(window))
                return
            self.done.append((tier, window))

    def finish(self) -> None:
        for tier in reversed(self.tiers):
            self.pack(tier)
        left = deque(p for t in reversed(self.tiers) for p in self.pools[t])
        total = sum(len(p.ids) for p in left)
        for bit in reversed(range(total.bit_length())):
            size = total & (1 << bit)
            while size > self.tiers[-1]:  # no window is longer than the longest tier
                self.last(left, self.tiers[-1])
                size -= self.tiers[-1]
            if size:
                self.last(left, size)
        self.pools = {t: deque() for t in self.tiers}

    def last(self, left: deque[Piece], size: int) -> None:
        window, gap = [], size
        while gap:
            piece = left.popleft()
            if len(piece.ids) > gap:
                piece, rest = piece.cut(gap)
                left.appendleft(rest)
            window.append(piece)
            gap -= len(piece.ids)
        self.done.append((size, window))

    def take(self) -> list[tuple[int, list[Piece]]]:
        done, self.done = self.done, []
        return done


def _packed(tokenizer: tuple[str, str], tiers: tuple[int, ...], step_tokens: int, end: int, id_type: pa.DataType, schema: pa.Schema) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(*tokenizer).encode, Packer(tiers)
        base = TaskContext.get().partitionId() << NUMBERS
        number, tokens = 0, 0

        def rows(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            nonlocal number, tokens
            columns: list[list] = [[] for _ in schema]
            for size, window in windows:
                offset = 0
                for p in window:
                    row = (p.doc, p.start, len(p.ids), p.ids.tobytes(), p.of, base + number, offset, size, base + tokens // step_tokens)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += len(p.ids)
                number, tokens = number + 1, tokens + size
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, np.append(encode(text or ""), np.uint32(end)))
                if len(packer.done) >= 256:
                    yield rows(packer.take())
        packer.finish()
        yield rows(packer.take())

    return pack


def pack(docs: DataFrame, vocabulary: str, ranks: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, end: int = 0) -> DataFrame:
    """One row per piece: id_col, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, sequence_length, step_group.

    A document is the ids of its text and then `end`; each id lies in exactly one piece, each window is full, and
    its length is one of the tiers or, at a task's end, a smaller power of two. A null or empty text is the id
    `end` alone. Null ids and repeated rows are documents of their own; other columns are not read, an empty table
    gives no piece. vocabulary and ranks are file paths on every executor. docs is to be a scan of files, see above.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    kinds = [(id_col, id_type), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("sequence_length", T.LongType()), ("step_group", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in kinds])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(_packed((vocabulary, ranks), tiers, step_tokens, end, arrow.field(0).type, arrow), schema)
