"""SimHash near-duplicates, linked by a binary-trie self-join.

Fingerprints are bit strings, so a sorted run of them *is* a binary trie: a node is a
range with a common prefix, and its children are split by one binary prefix sum.  The
self-join starts at the pair (root, root), steps down both sides together, adds one to a
pair's differing bits where the sides part, and drops pairs beyond the error budget.

To spread the trie over tasks, each distinct fingerprint is sent to one trie per 16-bit
block: two fingerprints that differ in at most three bits agree in one of four blocks,
so no link is lost.  A block value that is shared by very many distinct fingerprints is
divided again by four 12-bit blocks of the rest, by the same argument.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices, stored, texts
from .components import components
from .skew import join_one, with_totals

BUDGET, SHINGLE = 3, 3
#: A block value with more distinct fingerprints than this is divided again.
HOT = 20_000
#: Pairs of nodes that one step of the self-join handles at once.
FRONT = 100_000
_prints = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_links = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def simhash(text: str, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, words between ASCII white space,
    ``width``-word shingles with repeats, XXH64 with seed 42; a bit is set if more than
    half of the hashes have it.  No words give 0; fewer than ``width`` are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), "<u8", n)
    counts = np.bincount((hashes.view(np.uint8).reshape(n, 8) + 256 * np.arange(8)).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits((counts @ _BITS * 2 > n).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long.  Null texts count as empty."""

    def run(batches):
        for batch in slices(batches):
            fp = np.array([simhash(x) for x in texts(batch.column("text"))], np.uint64).view(np.int64)
            yield batch_of(_prints, [batch.column("doc_id"), fp])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Disjoint sets over positions, merged by whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _spans(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges from ``lo`` of sizes ``n``: (which range, position), one per element."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def trie_join(keys: np.ndarray, values: np.ndarray, bits: int, budget: int = BUDGET) -> np.ndarray:
    """Joins, within each run of equal keys, the trie of the lowest ``bits`` bits of
    ``values`` (distinct, sorted in each run; the bits above agree) with itself.  Returns
    for each position the first position of its group of linked values."""
    forest = Forest(len(values))
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    lo, hi = starts[sizes > 1], (starts + sizes)[sizes > 1]
    ones: dict[int, np.ndarray] = {}
    stack = [(bits - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > FRONT:
            half = len(alo) // 2
            stack += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, diff))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        # a pair of nodes whose members are all linked already can add nothing
        change = np.r_[0, np.cumsum(forest.root[1:] != forest.root[:-1])]
        open_ = (change[ahi - 1] != change[alo]) | (change[bhi - 1] != change[blo]) | (forest.root[alo] != forest.root[blo])
        alo, ahi, blo, bhi, diff = (x[open_] for x in (alo, ahi, blo, bhi, diff))
        # all pairs of a node pair link if the bits that are left can't exceed the budget
        whole = diff + bit + 1 <= budget
        for a, b, n in ((alo, alo, ahi - alo), (alo, blo, bhi - blo)):
            which, at = _spans(b[whole], n[whole])
            forest.link(a[whole][which], at)
        # leaves: small node pairs are compared value by value
        small = ~whole & ((ahi - alo) * (bhi - blo) <= 64)
        which, k = _spans(np.zeros(small.sum(), np.int64), ((ahi - alo) * (bhi - blo))[small])
        width = (bhi - blo)[small][which]
        i, j = alo[small][which] + k // np.maximum(width, 1), blo[small][which] + k % np.maximum(width, 1)
        near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        forest.link(i[near], j[near])
        go = ~whole & ~small
        alo, ahi, blo, bhi, diff = (x[go] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]
        c = ones[bit]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = alo == blo
        children = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1)]
        children.append(tuple(x[~same] for x in (amid, ahi, blo, bmid, diff + 1)))
        alo, ahi, blo, bhi, diff = map(np.concatenate, zip(*children))
        keep = (ahi > alo) & (bhi > blo) & (diff <= budget) & ~((alo == blo) & (ahi - alo == 1))
        if keep.any():
            stack.append((bit - 1, *(x[keep] for x in (alo, ahi, blo, bhi, diff))))
    return forest.root


def _join_groups(batches):
    """Streams rows (key, fp) that arrive sorted by key; emits for every fingerprint that
    is linked within its key one link to its group's first: never all pairs."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray):
        rows = rows[np.lexsort((rows[:, 1].view(np.uint64), rows[:, 0]))]
        values = np.ascontiguousarray(rows[:, 1]).view(np.uint64)
        root = trie_join(rows[:, 0], values & np.uint64(2**48 - 1), 48)
        at = np.flatnonzero(root != np.arange(len(root)))
        block = np.minimum(rows[:, 2], 3).astype(np.uint64) * np.uint64(16)
        real = (values >> block) | (values << ((np.uint64(64) - block) & np.uint64(63)))
        real = np.where(block == 0, values, real).view(np.int64)
        if len(at):
            yield batch_of(_links, [real[root[at]], real[at]])

    for batch in batches:
        rows = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "turned", "block")], 1).astype(np.int64)
        if not len(rows):
            continue
        held.append(rows)
        last = rows[-1, 0]
        if held[0][0, 0] != last and sum(map(len, held)) >= 50_000:
            data = np.concatenate(held)
            cut = np.searchsorted(data[:, 0], last)
            yield from links(data[:cut])
            held = [data[cut:]]
    if held:
        yield from links(np.concatenate(held))


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): their components are those
    of all pairs within the budget."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("block")
    rows = distinct.select("fp", turns)
    left, right = "shiftleft(fp, 16 * block)", "shiftrightunsigned(fp, 64 - 16 * block)"
    rows = rows.withColumn("turned", F.expr(f"if(block = 0, fp, {left} | {right})"))
    # the top 16 bits are shared within a key, the other 48 take part in the join
    rows = rows.withColumn("key", F.expr("block * 65536L + shiftrightunsigned(turned, 48)"))
    hot = rows.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    rows = rows.join(hot, "key", "left")
    parts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(-1))))
    rows = rows.select("turned", "block", "key", parts.alias("part"))
    finer = "1099511627776L + (key * 4 + part) * 4096 + (shiftrightunsigned(turned, 12 * part) & 4095)"
    rows = rows.select(F.expr(f"if(part < 0, key, {finer})").alias("key"), "turned", "block")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_join_groups, "a long, b long")


def near_components(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp, a stored table) with component_id: the smallest doc_id
    reachable over fingerprints that differ in at most three bits.

    Equal fingerprints are one node, however many documents have them.  Null doc_ids are
    passed over when the smallest is sought; repeated doc_ids keep their rows; an empty
    table gives no rows.
    """
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(near_links(distinct.select("fp")), "a", "b")
    classes = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    classes = with_totals(classes, "root", "fp", component_id=("min", "first")).select("fp", "component_id")
    return join_one(prints, classes, "fp", "doc_id").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (doc_id, text)."""
    return near_components(stored(fingerprints(docs), "simhash"))


def op9_simhash_trie(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
