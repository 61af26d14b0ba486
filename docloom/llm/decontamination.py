"""Benchmark decontamination by winnowing.

A window is 8 consecutive words of a benchmark item.  With 4-word grams, an 8-word window
holds 5 of them; its winnowing fingerprint is the least of their hashes.  Documents are
winnowed alike, fingerprints are joined, and a joined window is extended to its 8 words,
which must be equal too: every shared span of 8 words is found, and nothing else.
An item of fewer words is one window, below what winnowing guarantees; such windows are
joined by the hash of the whole.

The join is Spark's, so the benchmark may have any size.  Before it, a Bloom filter of the
benchmark's fingerprints, of at most ``FILTER_BITS`` bits, drops the windows of documents
that can't join; what it lets through by mistake the join drops.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, filesystem, scratch, slices, stored, texts

WINDOW, GRAM = 8, 4
#: Bits of the filter for a fingerprint, and at most; numbers of bits a fingerprint sets.
BITS, FILTER_BITS, PROBES = 32, 1 << 29, 4
#: Parts that the hits of a text are given to, so that many copies of it are dealt.
SALTS = 16
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of UTF-8: A-Z lower-cased, ASCII but letters and digits to a space.
_FOLD = bytes(c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
SPANS = "array<struct<start:int,stop:int>>"
PLACES = "array<struct<fp:long,at:int,size:int,words:string>>"
_span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_place = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("words", pa.string())]))
_seen = pa.schema([("doc_id", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("n_words", pa.int64()), ("places", _place)])
_found = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _span)])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of a flow of word hashes."""
    n, by = max(0, len(h) - size + 1), _mixed(np.arange(size, dtype=np.uint64) + np.uint64(1000 * size)) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += h[j : j + n] * by[j]
    return _mixed(out)


def fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """Of every window of ``size`` words of a flow: the least hash of its grams, or for a
    short window the hash of the whole."""
    if size < WINDOW:
        return _runs(h, size)
    grams = _runs(h, GRAM)
    n = max(0, len(h) - WINDOW + 1)
    return np.minimum.reduce([grams[i : i + n] for i in range(WINDOW - GRAM + 1)]) if n else np.empty(0, np.uint64)


def _bits(fp: np.ndarray, size: int) -> list[np.ndarray]:
    step = _mixed(fp) | np.uint64(1)
    return [(fp + np.uint64(k) * step) & np.uint64(size - 1) for k in range(PROBES)]


def _flow(data: list[str]):
    """(words of all texts, their hashes, numbers of words, starts)"""
    words, sizes = [], []
    for x in data:
        own = words_of(x)
        words += own
        sizes.append(len(own))
    sizes = np.array(sizes, np.int64)
    return words, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), sizes, np.cumsum(sizes) - sizes


class Index:
    """A benchmark's windows: ``table`` (fp, size, words, items) in the shared folder, the
    sizes that there are (at most ``WINDOW``), and the filter's folder and bits."""

    def __init__(self, benchmark: DataFrame):
        spark = benchmark.sparkSession

        def windows(batches):
            for batch in slices(batches, 64):
                out = [[], [], [], []]
                for item, text in zip(batch.column("item").to_pylist(), texts(batch.column("text"))):
                    words, h, _, _ = _flow([text])
                    size = min(WINDOW, len(words))
                    for k, fp in enumerate(fingerprints(h, size).view(np.int64).tolist() if size else ()):
                        for x, v in zip(out, (fp, size, b" ".join(words[k : k + size]).decode(), item)):
                            x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["fp", "size", "words", "item"])

        every = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(windows, "fp long, size int, words string, item string")
        self.table = stored(every.groupBy("fp", "size", "words").agg(F.collect_set("item").alias("items")), "benchmark-windows")
        counts = {x["size"]: x["n"] for x in self.table.groupBy("size").agg(F.count("*").alias("n")).collect()}
        self.sizes, n = sorted(counts), sum(counts.values())
        self.bits = min(FILTER_BITS, 1 << max(6, (BITS * n - 1).bit_length()))
        bits = self.bits

        def marks(batches):
            for batch in batches:
                at = np.unique(np.concatenate(_bits(batch.column("fp").to_numpy().view(np.uint64), bits)))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

        self.folder = scratch(spark, "benchmark-filter")
        self.table.select("fp").mapInArrow(marks, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).write.parquet(self.folder)


@lru_cache(maxsize=1)
def _filter(folder: str, bits: int) -> np.ndarray:
    files, path = filesystem(folder)
    rows = pq.read_table(path, filesystem=files, columns=["word", "bit"])
    out = np.zeros(bits >> 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return out


def _passing(fp: np.ndarray, own: np.ndarray, bits: int) -> np.ndarray:
    """Which fingerprints are in the filter."""
    at = np.arange(len(fp))
    for k in range(PROBES):
        place = _bits(fp[at], bits)[k]
        at = at[(own[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)) > 0]
    return at


def _winnow(docs: DataFrame, index: Index) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): its text as two hashes, the number of its
    words, and the windows that may be in the benchmark."""
    folder, bits, sizes = index.folder, index.bits, index.sizes

    def run(batches):
        own = _filter(folder, bits) if sizes else None
        for batch in slices(batches):
            words, h, counts, starts = _flow(texts(batch.column("text")))
            places = [[] for _ in counts]
            for size in sizes:
                fp = fingerprints(h, size)
                at = _passing(fp, own, bits)
                doc = np.searchsorted(starts, at, "right") - 1  # of empty documents at the same place, the last
                inside = at + size <= (starts + counts)[doc]
                for d, k, x in zip(doc[inside].tolist(), at[inside].tolist(), fp[at[inside]].view(np.int64).tolist()):
                    places[d].append({"fp": x, "at": k - int(starts[d]), "size": size, "words": b" ".join(words[k : k + size]).decode()})
            yield batch_of(_seen, [batch.column("doc_id"), batch.column("one"), batch.column("two"), counts, places])

    return docs.select("doc_id", *_text_hashes(), "text").mapInArrow(run, f"doc_id long, one long, two long, n_words long, places {PLACES}")


def _text_hashes():
    return [F.xxhash64("text").alias("one"), F.xxhash64("text", F.lit(1)).alias("two")]


def _hits(seen: DataFrame, index: Index) -> DataFrame:
    """(one, two, places, items) of the texts that have windows of the benchmark, for each
    of ``SALTS`` salts.  Copies of a text count once, and frequent windows are dealt by
    salt to all tasks."""
    own = seen.where(F.size("places") > 0).select("one", "two", F.explode("places").alias("p")).select("one", "two", "p.*").distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    windows = index.table.withColumn("salt", salts)
    joined = own.withColumn("salt", F.pmod("one", F.lit(SALTS)).cast("int")).join(windows, ["fp", "size", "words", "salt"])
    texts_ = joined.groupBy("one", "two").agg(F.collect_list(F.struct("at", "size")).alias("places"), F.collect_set(F.struct("size", "items")).alias("named"))
    return texts_.withColumn("salt", salts)


def _merged(places: list[dict]) -> list[dict]:
    """Places (at, size) as spans; those that overlap or touch are one."""
    out: list[list[int]] = []
    for start, stop in sorted((p["at"], p["at"] + p["size"]) for p in places):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [{"start": a, "stop": b} for a, b in out]


def _names(named: list[dict] | None, least: int = 0) -> list[str]:
    return sorted({item for x in named or () if x["size"] >= least for item in x["items"]})


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit, items (names as strings, sorted)
    and spans (of hit words, from word ``start`` to before ``stop``).

    Null texts and texts without words have no words and no hits.  Benchmark rows that
    are null, empty or repeated add nothing; an item whose item_id is null marks words but
    has no name.  Either table may be empty.
    """
    index = Index(benchmark)
    seen = stored(_winnow(docs, index), "winnowed")

    def run(batches):
        for batch in batches:
            spans = [_merged(x or ()) for x in batch.column("places").to_pylist()]
            hit = [sum(x["stop"] - x["start"] for x in own) for own in spans]
            yield batch_of(_found, [batch.column("doc_id"), batch.column("n_words"), hit, [_names(x) for x in batch.column("named").to_pylist()], spans])

    salt = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SALTS)).cast("int")
    own = seen.select("doc_id", "one", "two", "n_words", salt.alias("salt")).join(_hits(seen, index), ["one", "two", "salt"], "left")
    return own.select("doc_id", "n_words", "places", "named").mapInArrow(run, f"doc_id long, n_words long, n_hit long, items array<string>, spans {SPANS}")


def cut_words(text: str, spans: list[dict]) -> str:
    """``text`` without the words in the spans, and what stands between them."""
    at, out, last = [m.span() for m in WORD.finditer(text.translate(_UPPER))], [], 0
    for s in spans:
        out.append(text[last : at[s["start"]][0]].rstrip())
        last = at[s["stop"] - 1][1]
    out.append(text[last:].lstrip())
    return " ".join(x for x in out if x)


_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_items: int = 0, short: bool = True) -> DataFrame:
    """``docs`` (with doc_id, text and any other columns) without the documents that hold
    windows of more than ``most_items`` items; from the others, hit words are cut and
    n_chars, if there is such a column, is set anew.  Texts without hits stay as they are.
    Without ``short``, items of fewer than ``WINDOW`` words count for no document: they are cut.
    """
    index, schema = Index(benchmark), docs.schema
    names = docs.columns
    seen = stored(_winnow(docs.select("doc_id", "text"), index).where(F.size("places") > 0).drop("doc_id", "n_words"), "winnowed")
    least = 0 if short else WINDOW

    def run(batches):
        for batch in slices(batches):
            places, named = ([x for x in batch.column(f).to_pylist()] for f in ("__places", "__named"))
            keep = [len(_names(x, least)) <= most_items for x in named]
            columns = {f: batch.column(f) for f in names}
            if any(x and k for x, k in zip(places, keep)):
                cut = [cut_words(t, _merged(x)) if x and k else t for t, x, k in zip(columns["text"].to_pylist(), places, keep)]
                columns["text"] = pa.array(cut, columns["text"].type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in cut], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[f] for f in names], names=names).filter(pa.array(keep, pa.bool_()))

    hits = _hits(seen, index).select(*(F.col(f).alias(f"__{f}") for f in ("one", "two", "salt", "places", "named")))
    one, two = _text_hashes()
    same = (one == F.col("__one")) & (two == F.col("__two")) & (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SALTS)) == F.col("__salt"))
    return docs.join(hits, same, "left").select(*names, "__places", "__named").mapInArrow(run, schema)


def op10_winnowing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))
