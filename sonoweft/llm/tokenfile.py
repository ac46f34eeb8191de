"""Token-id files: one zstandard frame per document, an index and a seek table.

Layout of a file, in order:

1. for each document, a zstandard frame with its ids as little-endian unsigned
   32-bit integers; the frame stores its content size and content checksum;
2. a skippable frame (magic 0x184D2A50) with the compressed document index:
   ids, null flags and token counts;
3. a skippable frame (magic 0x184D2A5E), the seek table of the public seekable
   zstandard format: per frame the compressed size, the decompressed size and
   the low 32 bits of the XXH64 of the decompressed bytes; then the number of
   frames, a descriptor byte and the magic 0x8F92EAB1.

Any zstandard tool decompresses the whole file; a reader of some documents
reads the tail and then only the frames it needs.

Defined results: a null text counts as empty and has only its end id; a null
doc_id is written (and sorts first); repeated rows are written as often as they
occur; ties in doc_id are ordered by text; an empty table makes no files.
Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared, tokens

INDEX_MAGIC, SEEK_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "part int, path string, first_doc_id long, last_doc_id long, documents long, ids long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class FrameWriter:
    """Writes one file; ``close`` appends the index and the seek table."""

    def __init__(self, stream, level: int = 1):
        self.stream, self.bytes, self.ids = stream, 0, 0
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.docs: list[int | None] = []
        self.entries: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zstd.compress(ids)
        self.stream.write(frame)
        self.bytes += len(frame)
        self.ids += len(ids) // 4
        self.docs.append(doc_id)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))

    def close(self) -> None:
        known = np.array([d is not None for d in self.docs], "u1")
        index = self.zstd.compress(np.array([d or 0 for d in self.docs], "<i8").tobytes() + known.tobytes())
        table = np.array(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self.entries), 0x80, END_MAGIC)
        tail = struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", SEEK_MAGIC, len(table)) + table
        self.stream.write(tail)
        self.bytes += len(tail)
        self.stream.close()


class FrameReader:
    """Opens a file by its tail; ``frames`` decompresses the wanted documents only."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != END_MAGIC or not flags & 0x80:
            raise ValueError("the file has no seek table")
        table = size - 9 - 12 * n - 8
        file.seek(table)
        head = struct.unpack("<II", file.read(8))
        if head != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.entries = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        file.seek(int(self.at[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != INDEX_MAGIC or self.at[-1] + 8 + length != table:
            raise ValueError("the document index is damaged")
        self.zstd = zstandard.ZstdDecompressor()
        index = self.zstd.decompress(file.read(length), max_output_size=9 * n + 1)
        self.known = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.docs = np.frombuffer(index, "<i8", n)
        self.counts = self.entries[:, 1] // 4

    def frames(self, wanted: np.ndarray, run: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
        """(place, id bytes) of the wanted places, ascending; neighbours are read together."""
        i = 0
        while i < len(wanted):
            j = i + 1
            while j < len(wanted) and wanted[j] == wanted[j - 1] + 1 and self.at[wanted[j] + 1] - self.at[wanted[i]] <= run:
                j += 1
            first = int(self.at[wanted[i]])
            self.file.seek(first)
            data = self.file.read(int(self.at[wanted[j - 1] + 1]) - first)
            for k in wanted[i:j]:
                ids = self.zstd.decompress(data[self.at[k] - first : self.at[k + 1] - first], max_output_size=int(self.entries[k, 1]) + 1)
                if len(ids) != self.entries[k, 1] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.entries[k, 2]:
                    raise ValueError(f"frame {k} is damaged")
                yield int(k), ids
            i = j


def write(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", end_id: int = 2) -> DataFrame:
    """Writes (doc_id, text) in ascending doc_id order below ``folder``; returns the manifest.

    Each task writes one file under a name of its own, and only files that the
    manifest names count: what a lost or repeated task leaves behind is unused.
    """
    spark = docs.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, path = TaskContext.get().partitionId(), None, ""
        encoder, end = tokens.encoder(tokenizer, kind), struct.pack("<I", end_id)
        for some in tokens.slices(batches, 1):
            if writer is None:
                files, top = pafs.FileSystem.from_uri(folder)
                files.create_dir(top, recursive=True)
                path = f"{top}/part-{part:06d}-{uuid.uuid4().hex}.zst"
                writer = FrameWriter(files.open_output_stream(path, compression=None))
            flat, starts = encoder.encode(some.column(1))
            for i, doc_id in enumerate(some.column(0).to_pylist()):
                writer.add(doc_id, flat[starts[i] : starts[i + 1]].tobytes() + end)
        if writer is not None:
            writer.close()
            ids = [d for d in writer.docs if d is not None]
            row = (part, path.rpartition("/")[2], min(ids, default=None), max(ids, default=None), len(writer.docs), writer.ids, writer.bytes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.string(), *[pa.int64()] * 5], strict=True)],
                names=[f.split()[0] for f in MANIFEST.split(", ")],
            )

    laid = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    made = laid.mapInArrow(task, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def based(manifest: DataFrame) -> DataFrame:
    """The manifest (one row per file) with the ids that stand before each file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _digests(path: str, base: int, wanted: np.ndarray | None, folder: str) -> Iterator[pa.RecordBatch]:
    files, top = pafs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{top}/{path}") as file:
        reader = FrameReader(file)
        starts = base + np.concatenate([[0], np.cumsum(reader.counts)])
        places = np.arange(len(reader.docs)) if wanted is None else np.flatnonzero(reader.known & np.isin(reader.docs, wanted))
        for i in range(0, len(places), 4096):
            some = places[i : i + 4096]
            crc = [zlib.crc32(ids) for _, ids in reader.frames(some)]
            docs = pa.array(reader.docs[some], pa.int64(), mask=~reader.known[some])
            yield pa.RecordBatch.from_arrays([docs, pa.array(starts[some], pa.int64()), pa.array(reader.counts[some], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads every file back: doc_id, start, n_tokens, ids_crc32."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _digests(path, base, None, folder)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based(manifest).select("path", "base").repartition(tasks, "path").mapInArrow(task, READ)


def read_documents(manifest: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The ids of the wanted doc_ids only: doc_id, ids array<long>.

    A file's range of doc_ids selects it, its index selects frames; no other
    frame is read or decompressed. A wanted id that no file has gives no row.
    """
    ranges = F.broadcast(manifest.select("path", "first_doc_id", "last_doc_id"))
    hits = wanted.select("doc_id").distinct().join(ranges, F.col("doc_id").between(F.col("first_doc_id"), F.col("last_doc_id")))

    def task(group: pa.Table) -> pa.Table:
        files, top = pafs.FileSystem.from_uri(folder)
        with files.open_input_file(f"{top}/{group.column('path')[0].as_py()}") as file:
            reader = FrameReader(file)
            places = np.flatnonzero(reader.known & np.isin(reader.docs, group.column("doc_id").to_numpy()))
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for _, x in reader.frames(places)]
        return pa.table({"doc_id": pa.array(reader.docs[places], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return hits.select("path", "doc_id").groupBy("path").applyInArrow(task, "doc_id long, ids array<long>")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = shared.new_path(spark, "token-files")
    return read_digests(write(docs, folder, tokenizer), folder)
