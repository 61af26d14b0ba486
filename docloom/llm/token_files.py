"""Token-ID files: bit-plane shuffled blocks under zstandard, with a chunk index.

File layout (little-endian)::

    b"DLTK1\\n"
    chunks: for each block of up to ``block`` ids, 4 byte planes (plane k holds byte k
            of every id), each a zstandard frame
    documents: zstandard frame of doc_id int64[n], null flag uint8[n], n_tokens int64[n]
    index: for each chunk: ids uint32, offset uint64, 4 plane lengths uint32
    tail: index offset uint64, chunks uint64, documents offset uint64, documents length
          uint64, documents uint64, block uint32, b"DLTK"

A block's high planes are nearly constant, so they shrink to a few bytes.  Any id range
is read by the chunks that cover it.  A document may span chunks; a shard holds
consecutive documents in ascending doc_id order.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import tokens
from .common import batch_of, create, filesystem, scratch, slices, stored, texts

MAGIC, TAIL = b"DLTK1\n", struct.Struct("<QQQQQI4s")
INDEX = np.dtype([("ids", "<u4"), ("offset", "<u8"), ("planes", "<u4", 4)])
MANIFEST = "path string, shard int, first_doc long, n_docs long, n_tokens long"
_manifest = pa.schema([("path", pa.string()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_rows = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class Writer:
    """Appends documents; holds one block of ids and 16 bytes a document in memory."""

    def __init__(self, uri: str, block: int = 65536, level: int = 3):
        self.out, self.at, self.block, self.zip = create(uri), 0, block, zstandard.ZstdCompressor(level=level)
        self.index, self.docs, self.lengths, self.rest, self.held = [], [], [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _chunk(self, data: bytes) -> None:
        planes, offset = np.frombuffer(data, np.uint8).reshape(-1, 4).T, self.at
        self.index.append((len(data) // 4, offset, [self._put(self.zip.compress(p.tobytes())) for p in planes]))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            data, size = b"".join(self.rest), 4 * self.block
            cut = len(data) - len(data) % size
            for i in range(0, cut, size):
                self._chunk(data[i : i + size])
            self.rest, self.held = [data[cut:]], len(data) - cut

    def close(self) -> None:
        if self.held:
            self._chunk(b"".join(self.rest))
        docs_at, n = self.at, len(self.docs)
        table = np.array([x or 0 for x in self.docs], "<i8").tobytes() + np.array([x is None for x in self.docs], np.uint8).tobytes() + np.array(self.lengths, "<i8").tobytes()
        docs_len, index_at = self._put(self.zip.compress(table)), self.at
        self._put(np.array(self.index, INDEX).tobytes())
        self._put(TAIL.pack(index_at, len(self.index), docs_at, docs_len, n, self.block, b"DLTK"))
        self.out.close()


class Reader:
    """Random access to one file: documents, and ids by position."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        index_at, chunks, docs_at, docs_len, n, self.block, mark = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        if mark != b"DLTK" or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.index = np.frombuffer(self._at(index_at, chunks * INDEX.itemsize), INDEX)
        self.unzip = zstandard.ZstdDecompressor()
        table = self.unzip.decompress(self._at(docs_at, docs_len), max_output_size=17 * n + 1)
        ids, null = np.frombuffer(table, "<i8", n), np.frombuffer(table, np.uint8, n, 8 * n)
        self.docs = [None if z else int(x) for x, z in zip(ids, null)]
        self.lengths = np.frombuffer(table, "<i8", n, 9 * n)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def chunk(self, k: int) -> bytes:
        """The ids of chunk k as little-endian bytes."""
        row = self.index[k]
        data, at, n = self._at(int(row["offset"]), int(row["planes"].sum())), 0, int(row["ids"])
        out = np.empty((n, 4), np.uint8)
        for p, size in enumerate(row["planes"]):
            out[:, p] = np.frombuffer(self.unzip.decompress(data[at : at + size], max_output_size=n), np.uint8)
            at += size
        return out.tobytes()

    def ids(self, start: int, stop: int) -> bytes:
        """The ids at positions start to stop of the shard, by the chunks that hold them."""
        if stop <= start:
            return b""
        first, last = start // self.block, (stop - 1) // self.block
        data = b"".join(map(self.chunk, range(first, last + 1)))
        return data[4 * (start - first * self.block) : 4 * (stop - first * self.block)]

    def documents(self):
        """(doc_id, position, ids as bytes) in order; holds a chunk and one document."""
        data, place, k, at = b"", 0, 0, 0
        for doc, n in zip(self.docs, self.lengths.tolist()):
            if len(data) - place < 4 * n:
                parts, have = [data[place:]], len(data) - place
                while have < 4 * n:
                    parts.append(self.chunk(k))
                    have, k = have + len(parts[-1]), k + 1
                data, place = b"".join(parts), 0
            yield doc, at, data[place : place + 4 * n]
            place, at = place + 4 * n, at + n

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, block: int = 65536) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes shards in ascending doc_id order;
    returns the manifest, one row per shard, as a stored table.

    Texts are range-partitioned by doc_id, so no task holds more than its range and the
    shards follow each other.  Null texts count as empty, null ids come first, repeated
    ids are ordered by text; an empty table gives no shard.  A retried task writes files
    under new names; only files in the manifest are part of the result.
    """

    def encode(batches):
        from pyspark import TaskContext

        shard, uri, writer, n, first, count = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.dltk", None, 0, None, 0
        get = tokens.encoder(path, end_id)
        for batch in slices(batches, 2048):
            names = batch.column("doc_id").to_pylist()
            for name, ids in zip(names, get(texts(batch.column("text")))):
                if writer is None:
                    writer, first = Writer(uri, block), name
                writer.add(name, ids)
                n, count = n + len(ids) // 4, count + 1
        if writer:
            writer.close()
            yield batch_of(_manifest, [[uri], [shard], [first], [count], [n]])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(encode, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32, from the files.

    The driver sums the shards' counts: a few numbers per shard, none per document.
    """
    spark, base, rows = manifest.sparkSession, 0, []
    for x in manifest.orderBy("shard").toLocalIterator():
        rows.append((x.path, base))
        base += x.n_tokens
    shards = spark.createDataFrame(rows, "path string, base long")
    shards = shards.repartition(max(1, len(rows)), "path") if rows else shards

    def decode(batches):
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                reader, out = Reader(uri), []
                for doc, at, ids in reader.documents():
                    out.append((doc, base + at, len(ids) // 4, zlib.crc32(ids)))
                    if len(out) == 4096:
                        yield batch_of(_rows, list(map(list, zip(*out))))
                        out = []
                reader.close()
                if out:
                    yield batch_of(_rows, list(map(list, zip(*out))))

    return shards.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, scratch(spark, "tokens"), tokens.default_path()))
