"""Token ids in binary record files: length-delimited frames with masked checksums, and an offset index.

A shard holds frames in ascending doc_id order, shard after shard. A frame is
    length of the payload, uint64 | masked checksum of these 8 bytes, uint32 | payload | masked checksum of it, uint32
all little-endian; the payload is the sequence's ids as uint16 or uint32. The checksum is CRC-32, masked by
rotating it 15 bits to the right and adding a constant, so that checksums of checksummed data stay sound.
The index beside a shard (ids, frame offsets, lengths, itself under a checksum) lets a reader take any record
in any order with one positioned read.

Every attempt of a task writes files of its own name; the manifest, committed by Spark, names those of the
attempts that count. A lost executor leaves at most files that no manifest names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.llm.common import as_text, batch_of, in_order, new_path, parts_for, rows_of, stored
from panelnet.llm.word_tokens import id_type, vocabulary_path, word_ids

MASK = 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
INDEX_HEAD = struct.Struct("<8sIQ")
MAGIC = b"PNINDEX1"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, TAIL.pack(masked(length)), payload, TAIL.pack(masked(payload))))


def read_frame(file, offset: int | None = None) -> bytes:
    """The payload of the frame at offset, or of the next one; ValueError if a checksum does not hold."""
    if offset is not None:
        file.seek(offset)
    head = file.read(HEAD.size)
    if len(head) < HEAD.size:
        raise ValueError("a frame is cut short")
    length, crc = HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise ValueError("a frame's length is damaged")
    payload = file.read(length)
    tail = file.read(TAIL.size)
    if len(payload) < length or len(tail) < TAIL.size or masked(payload) != TAIL.unpack(tail)[0]:
        raise ValueError("a frame's payload is damaged")
    return payload


def write_index(file, width: int, ids: list[int | None], offsets: list[int], counts: list[int]) -> None:
    body = INDEX_HEAD.pack(MAGIC, width, len(ids))
    body += np.array([i is not None for i in ids], np.uint8).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()
    body += np.array(offsets, "<u8").tobytes() + np.array(counts, "<u8").tobytes()
    file.write(body + TAIL.pack(masked(body)))


def read_index(data: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(bytes of an id, doc ids, frame offsets, numbers of ids)."""
    magic, width, n = INDEX_HEAD.unpack_from(data)
    if magic != MAGIC or masked(data[:-4]) != TAIL.unpack_from(data, len(data) - 4)[0]:
        raise ValueError("the index is damaged")
    at = INDEX_HEAD.size
    valid = np.frombuffer(data, np.uint8, n, at)
    ids, offsets, counts = (np.frombuffer(data, t, n, at + n + 8 * n * k) for k, t in enumerate(("<i8", "<u8", "<u8")))
    return width, [int(i) if v else None for i, v in zip(ids, valid)], offsets, counts


_MANIFEST = "shard long, path string, n_docs long, n_ids long"


def _writer(folder: str, vocabulary: str, end: int, width: int):
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        parts = rows_of(batches, "doc_id", "text")
        first = next(parts, None)
        if first is None:
            return
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{shard:08d}-{uuid.uuid4().hex}"
        coder, ids, offsets, counts, at = word_ids(vocabulary), [], [], [], 0
        with fs.open_output_stream(f"{base}/{name}.rec", buffer_size=1 << 20) as out:
            part = first
            while part is not None:
                if coder.full():
                    coder.clear()
                for (doc_id, _), words in zip(part, coder.words([t for _, t in part])):
                    seq = coder.ids(words, end)
                    data = frame(seq.astype(f"<u{width}").tobytes())
                    out.write(data)
                    ids.append(doc_id)
                    offsets.append(at)
                    counts.append(len(seq))
                    at += len(data)
                part = next(parts, None)
        with fs.open_output_stream(f"{base}/{name}.idx") as out:
            write_index(out, width, ids, offsets, counts)
        yield batch_of(schema, [[shard], [name], [len(ids)], [sum(counts)]])

    return run


def write_records(docs: DataFrame, vocabulary: str | None = None, end: int = 1) -> tuple[str, DataFrame]:
    """Write docs(doc_id, text, ...) as record files in ascending doc_id; returns (folder, manifest).

    A null text is a sequence of the end id alone, as is an empty one. Null ids come first; rows that repeat an
    id stay, in the order of a hash of their texts. Other columns are ignored. An empty table writes no file.
    Ids take two bytes where the vocabulary allows, else four.
    """
    vocabulary = vocabulary or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text"))
    folder = new_path(docs.sparkSession, "records")
    sorted_docs = in_order(docs, parts_for(docs), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    run = _writer(folder, vocabulary, end, int(id_type(vocabulary, end)[2]))
    return folder, stored(sorted_docs.mapInArrow(run, _MANIFEST), "manifest")


def _reader(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_stream(f"{base}/{name}.idx") as f:
                    width, ids, _, counts = read_index(f.read())
                crcs = []
                with fs.open_input_stream(f"{base}/{name}.rec", buffer_size=1 << 20) as f:
                    for n in counts:
                        payload = read_frame(f)
                        if len(payload) != int(n) * width:
                            raise ValueError("the index and a record differ")
                        crcs.append(zlib.crc32(np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()))
                starts = start + np.cumsum(counts).astype(np.int64) - counts.astype(np.int64)
                yield batch_of(schema, [ids, starts, counts.astype(np.int64), crcs])

    return run


def read_records(folder: str, manifest: DataFrame) -> DataFrame:
    """The records of a manifest's files: (doc_id, start, n_tokens, ids_crc32), start counting all ids before.

    The driver sums the shards' counts; there is one small row for each shard.
    """
    spark, at, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("shard").select("path", "n_ids").toLocalIterator():
        rows.append((r.path, at))
        at += r.n_ids
    shards = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return shards.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
