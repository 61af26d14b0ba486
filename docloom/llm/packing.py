"""Best-fit packing of documents into sequences, after Martello and Toth's reduction.

Only lengths matter to a packing, and a sequence of C tokens knows at most C of them, so
the plan is made on the histogram of lengths: at most C counts, however many documents.
Equal decisions are taken together, as runs (a pattern of lengths, so many sequences).
Documents are then ranked within their length and looked up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import batch_of, slices, stored, texts

CAPACITY = 1024
#: Bytes of text that are encoded at once.
PART_BYTES = 2 << 20
#: Ranking within a length goes by so many buckets at least; more for more pieces.
BUCKET_ROWS = 200_000
_pieces = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of each document (doc_id, text): documents of more than
    ``capacity`` tokens are cut so that every piece but the first is full.

    Null texts count as empty and give the end id alone; an empty table gives no rows;
    repeated rows give repeated pieces.
    """

    def cut(batches):
        get = tokens.encoder(path, end_id)
        for batch in slices(batches, 2048, PART_BYTES):
            out = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), get(texts(batch.column("text")))):
                n = len(ids) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                for k, stop in enumerate(stops):
                    start = max(0, stop - capacity) if k else 0
                    for x, v in zip(out, (doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        x.append(v)
            yield batch_of(_pieces, out)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


class Plan:
    """Runs of sequences: for each length a list of (first rank, sequence, per sequence,
    offset): the items of that length with ranks from ``first rank`` on fill sequences
    from ``sequence`` on, so many in each, from ``offset`` on."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.left = {k: v for k, v in counts.items() if v}
        self.taken = dict.fromkeys(counts, 0)
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in counts}
        self.capacity, self.sequences = capacity, 0
        self.steps: dict[str, int] = {}
        self.fixed = self._reduce()
        self._best_fit()

    def _place(self, length: int, sequence: int, each: int, offset: int, items: int) -> None:
        self.runs[length].append((self.taken[length], sequence, each, offset))
        self.taken[length] += items
        self.left[length] -= items
        if not self.left[length]:
            del self.left[length]

    def _fix(self, *pattern: int) -> None:
        """As many sequences of this pattern as its lengths allow."""
        need = {x: pattern.count(x) for x in pattern}
        m, offset = min(self.left[x] // k for x, k in need.items()), 0
        for x, k in need.items():
            self._place(x, self.sequences, k, offset, k * m)
            offset += k * x
        self.sequences += m

    def _reduce(self) -> int:
        """Fixes sets that dominate every other set with one of their items, for all
        lengths from the largest on, until none is left; ``steps`` counts the sequences."""
        for x in sorted(self.left, reverse=True):  # a full sequence, or two items that fill one: nothing can do better by either
            if x == self.capacity:
                self._fixed("full", x)
            elif x > self.capacity - x and x in self.left and self.capacity - x in self.left:
                self._fixed("filled by two", x, self.capacity - x)
            elif 2 * x == self.capacity and self.left.get(x, 0) > 1:
                self._fixed("filled by two", x, x)
        before = -1
        while before < self.sequences:
            before = self.sequences
            for x in sorted(self.left, reverse=True):
                while x in self.left and (found := self._dominating(x)):
                    self._fixed(f"dominating {len(found)}", *found)
        return self.sequences

    def _fixed(self, step: str, *pattern: int) -> None:
        before = self.sequences
        self._fix(*pattern)
        self.steps[step] = self.steps.get(step, 0) + self.sequences - before

    def _dominating(self, top: int) -> tuple[int, ...] | None:
        """A set of up to three items with ``top`` that provably dominates all with it."""
        sizes = sorted(self.left)
        room = self.capacity - top

        def least(k: int) -> int:
            total, need = 0, k
            for x in sizes:
                n = min(need, self.left[x] - (x == top))
                total, need = total + n * x, need - n
                if not need:
                    return total
            return self.capacity + 1

        if least(1) > room:
            return (top,)
        fits = [x for x in sizes[: bisect_right(sizes, room)] if self.left[x] - (x == top) > 0]
        best = fits[-1]
        if least(2) > room:
            return (top, best)
        if least(3) > room:  # at most two more items
            def partner(x: int) -> int:
                for y in reversed(fits[: bisect_right(fits, min(x, room - x))]):
                    if self.left[y] - (y == top) - (y == x) > 0:
                        return y
                return 0

            pairs = {x: partner(x) for x in fits}
            if all(x + y <= best for x, y in pairs.items() if y):
                return (top, best)
            second = pairs[best]
            if second and all(y <= second or x + y <= best for x, y in pairs.items()):
                return (top, best, second)
        return None

    def _best_fit(self) -> None:
        """Best-fit decreasing on what remains; open sequences by room, in groups."""
        room: dict[int, list[tuple[int, int]]] = {}
        for x in sorted(self.left, reverse=True):
            while x in self.left:
                n = self.left[x]
                if fit := min((r for r in room if r >= x), default=0):
                    first, count = room[fit].pop()
                    if not room[fit]:
                        del room[fit]
                else:
                    fit, first = self.capacity, self.sequences
                    count = -(-n // (fit // x))
                    self.sequences += count
                each = fit // x
                used = min(count, n // each)
                if used:
                    self._place(x, first, each, self.capacity - fit, used * each)
                    self._open(room, fit - each * x, first, used)
                if used < count and (rest := n - used * each) and rest < each:
                    self._place(x, first + used, rest, self.capacity - fit, rest)
                    self._open(room, fit - rest * x, first + used, 1)
                    used += 1
                self._open(room, fit, first + used, count - used)

    @staticmethod
    def _open(room: dict, left: int, first: int, count: int) -> None:
        if left and count:
            room.setdefault(left, []).append((first, count))


def _ranked(pieces: DataFrame) -> DataFrame:
    """``rank``: from 0 within each length, over buckets, so that no length gathers in
    one task: ranks in a bucket plus what the buckets before it hold."""
    n = pieces.count()
    buckets = max(16, n // BUCKET_ROWS)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return keyed.withColumn("n", F.row_number().over(own) - 1).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("n") + F.col("before")).drop("n", "before", "bucket")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    ``pieces`` should be a stored table, as it is read for the histogram and again for
    the ranks.  Lengths are 1 to ``capacity``; equal lengths are ranked by doc_id, piece
    and checksum, so repeated rows take places of their own.  An empty table stays empty.
    """
    counts = {x.length: x["count"] for x in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    plan = Plan(counts, capacity)
    runs = {k: np.array(v, np.int64).reshape(-1, 4) for k, v in plan.runs.items()}
    schema = pa.schema([*_pieces, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def look_up(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                run = runs[int(x)]
                own = run[np.searchsorted(run[:, 0], rank[at], "right") - 1]
                k = rank[at] - own[:, 0]
                sequence[at], offset[at] = own[:, 1] + k // own[:, 2], own[:, 3] + k % own[:, 2] * x
            yield batch_of(schema, [*(batch.column(f.name) for f in _pieces), sequence, offset])

    return _ranked(pieces).mapInArrow(look_up, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    return pack(stored(token_pieces(docs, path or tokens.default_path(), end_id, capacity), "pieces"), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"))
