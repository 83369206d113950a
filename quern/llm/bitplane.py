"""Token-id files of bit planes.

A file is one shard: consecutive documents in ascending doc_id order. Its ids are cut into
chunks of a fixed number of ids; each chunk is transposed into bit planes (bit b of all its
ids, packed), planes that hold no bit are left out, and each other plane is compressed with
zstandard on its own. An index at the end says where chunks, planes and documents lie, so a
reader can fetch any document by decoding only its chunks.

    magic "QBP1" | planes of chunk 0 | planes of chunk 1 | ... | index | index size (u32) | magic

The index is zstandard-compressed little-endian: u32 chunk size, u64 ids, u32 chunks,
u32 documents; for each chunk its offset (u64) and the plane sizes (32 x u32, 0: no bit
set); for each document its doc_id (i64), a null mark (u8) and its number of ids (u64).

Spark writes the shards as binary rows of a table, so the commit of a task is atomic on any
file system and a lost executor leaves no half-written file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import doc_columns, staged
from quern.llm.tokens import encoder

MAGIC = b"QBP1"
CHUNK = 1 << 15


def write_shard(doc_ids: list, ids: list[bytes], chunk: int = CHUNK, level: int = 3) -> bytes:
    """One file from documents' uint32 ids."""
    squeeze = zstandard.ZstdCompressor(level=level)
    flat = np.frombuffer(b"".join(ids), "<u4")
    out, at, places, sizes = [MAGIC], len(MAGIC), [], []
    for begin in range(0, len(flat), chunk):
        part = flat[begin: begin + chunk]
        places.append(at)
        used = int(np.bitwise_or.reduce(part))
        row = np.zeros(32, "<u4")
        for b in range(32):
            if used >> b & 1:
                plane = squeeze.compress(np.packbits((part >> np.uint32(b)).astype(np.uint8) & 1, bitorder="little").tobytes())
                out.append(plane)
                row[b] = len(plane)
                at += len(plane)
        sizes.append(row)
    nulls = np.array([d is None or d != d for d in doc_ids], np.uint8)
    index = squeeze.compress(b"".join([
        struct.pack("<IQII", chunk, len(flat), len(places), len(doc_ids)), np.array(places, "<u8").tobytes(),
        np.array(sizes, "<u4").tobytes(), np.array([0 if n else int(d) for d, n in zip(doc_ids, nulls)], "<i8").tobytes(),
        nulls.tobytes(), np.array([len(x) // 4 for x in ids], "<u8").tobytes()]))
    return b"".join(out + [index, struct.pack("<I", len(index)), MAGIC])


class Shard:
    """Reads a file of write_shard."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or data[-4:] != MAGIC:
            raise ValueError("not a bit-plane file")
        size = struct.unpack("<I", data[-8:-4])[0]
        index = zstandard.ZstdDecompressor().decompress(data[-8 - size: -8])
        self.data = data
        self.chunk, self.total, chunks, docs = struct.unpack_from("<IQII", index)
        at = struct.calcsize("<IQII")

        def take(kind, n):
            nonlocal at
            found = np.frombuffer(index, kind, n, at)
            at += found.nbytes
            return found

        self.places, self.sizes = take("<u8", chunks), take("<u4", chunks * 32).reshape(-1, 32)
        self.doc_ids, self.nulls, self.counts = take("<i8", docs), take(np.uint8, docs), take("<u8", docs).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def part(self, number: int) -> np.ndarray:
        n = int(min(self.chunk, self.total - number * self.chunk))
        out, at = np.zeros(n, np.uint32), int(self.places[number])
        expand = zstandard.ZstdDecompressor()
        for b, size in enumerate(self.sizes[number].tolist()):
            if size:
                plane = np.frombuffer(expand.decompress(self.data[at: at + size]), np.uint8)
                out |= np.unpackbits(plane, count=n, bitorder="little").astype(np.uint32) << np.uint32(b)
                at += size
        return out

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids begin..end of the shard, from the chunks that hold them."""
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = begin // self.chunk, (end - 1) // self.chunk
        held = np.concatenate([self.part(k) for k in range(first, last + 1)])
        return held[begin - first * self.chunk: end - first * self.chunk]

    def documents(self):
        """(doc_id or None, start, ids) in order, each chunk decoded once."""
        held, first = np.empty(0, np.uint32), 0
        following = 0
        for doc, null, start, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.starts.tolist(), self.counts.tolist()):
            parts = [held[start - first:]]
            while following < len(self.places) and following * self.chunk < start + n:
                parts.append(self.part(following))
                following += 1
            held, first = np.concatenate(parts), start
            yield None if null else doc, start, held[:n]


def write(docs: DataFrame, path: str, end: int = 2, shard_ids: int = 1 << 21, chunk: int = CHUNK) -> DataFrame:
    """Encodes docs (doc_id, text), appends the id ``end`` to each, and writes shards of
    about ``shard_ids`` ids in ascending doc_id order. Returns the table of the files:
    shard int, file binary, documents long, ids long.

    Null doc_ids come first, in no order among themselves; rows that repeat a doc_id stand in the order of their ids. A
    null or empty text is the end id alone; one long text makes a longer shard. Extra
    columns are ignored; an empty table gives no shard."""
    tail = int(end).to_bytes(4, "little")
    narrow = doc_columns(docs, "doc_id", "text")

    # About four characters make an id; only the number of ranges, which are spread over tasks, depends on it.
    total = (narrow.agg(F.sum(F.length("text"))).first()[0] or 0) // 4
    count = int(min(1 << 16, max(1, -(-total // shard_ids))))  # larger ranges are written in several parts
    bounds = [] if count == 1 else sorted({int(x) for x in narrow.approxQuantile("doc_id", [i / count for i in range(1, count)], 1 / (8 * count))})
    edges = np.array(bounds, np.int64)

    def encode(batches):
        ids = encoder(path)
        kind = np.dtype("<u2" if max(ids.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4")
        for pdf in batches:
            data = [np.frombuffer(ids(t) + tail, "<u4").astype(kind).tobytes() for t in pdf["text"]]
            doc = pdf["doc_id"].astype("Int64")
            # Null doc_ids have no order among themselves, so they are spread over files of their own.
            shard = np.where(doc.isna(), [-1 - zlib.crc32(d) % count for d in data], np.searchsorted(edges, doc.fillna(0).to_numpy(np.int64), "right"))
            yield pd.DataFrame({"shard": shard.astype(np.int32), "doc_id": doc, "width": np.int8(kind.itemsize), "ids": data})

    coded = narrow.mapInPandas(encode, "shard int, doc_id long, width byte, ids binary")

    def pack(batches):
        """Rows of a partition come sorted, so one part of a shard at a time is in memory."""
        shard, part, docs_, held, size = None, 0, [], [], 0

        def made():
            return pd.DataFrame([(shard, part, write_shard(docs_, held, chunk), len(docs_), size)], columns=["shard", "part", "file", "documents", "ids"])

        for pdf in batches:
            for number, doc, ids, width in zip(pdf["shard"].tolist(), pdf["doc_id"], pdf["ids"], pdf["width"]):
                if number != shard or size >= shard_ids:
                    if held:
                        yield made()
                    shard, part, docs_, held, size = number, part + 1 if number == shard else 0, [], [], 0
                held.append(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                docs_.append(None if pd.isna(doc) else int(doc))
                size += len(held[-1]) // 4
        if held:
            yield made()

    ordered = coded.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return staged(ordered.mapInPandas(pack, "shard int, part int, file binary, documents long, ids long"), "shards")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    sizes = files.select("shard", "part", "ids")
    before = F.sum("ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each file.
    bases = sizes.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches):
        for pdf in batches:
            for data, base in zip(pdf["file"], pdf["base"]):
                rows = [(doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, start, ids in Shard(data).documents()]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    return (files.join(bases, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p"))).select("file", "base")
            .mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))
