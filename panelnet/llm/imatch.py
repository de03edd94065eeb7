"""I-Match fingerprints over a band of inverse document frequency, for several randomised lexicon subsets.

Document frequencies are counted over all documents in 2^22 hashed terms: the count arrays, and the lexicon as
a bitmap of 512 KB, have the same size for any corpus, so the bitmap is safe to send to every task. A hashed term
holds, besides its own, about 1e-4 of the documents by chance, far below the band's lower end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.llm.common import as_text, batch_of, in_order, parts_for, rows_of, stored
from panelnet.llm.words import hash_words, mix64, separators

BITS, SLICE_BITS = 22, 12
#: The band: terms of at least and at most these shares of the documents.
BAND = (0.002, 0.02)
#: Subset s keeps a term with probability 2^-DENSITY[s]; dense subsets tell near copies, sparse ones looser likeness.
DENSITY = np.repeat(np.array([1, 2, 3, 4, 5], np.uint64), [4, 4, 4, 6, 6])
_SEP = separators(bytes(c for c in range(128) if not chr(c).isalnum()))
_SALT = mix64(np.arange(1, len(DENSITY) + 1, dtype=np.uint64))


def _hashes(texts: list[str]) -> list[np.ndarray]:
    *_, h, first = hash_words([t.encode().lower() for t in texts], _SEP)
    return np.split(h, first[1:-1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BITS, np.uint32)
    for part in rows_of(batches, "text"):
        for h in _hashes([t for (t,) in part]):
            counts[np.unique(h >> np.uint64(64 - BITS))] += np.uint32(1)
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])
    width = 1 << SLICE_BITS
    rows = [(s, zlib.compress(counts[s * width : (s + 1) * width].tobytes(), 1)) for s in range(1 << (BITS - SLICE_BITS)) if counts[s * width : (s + 1) * width].any()]
    if rows:
        yield batch_of(schema, list(zip(*rows)))


def _band(n: int, low: float, high: float):
    schema = pa.schema([("slice", pa.int32()), ("terms", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def closed() -> pa.RecordBatch:
            return batch_of(schema, [[at], [np.packbits((total >= max(1, low * n)) & (total <= high * n)).tobytes()]])

        for batch in batches:
            for s, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                if s != at:
                    if at is not None:
                        yield closed()
                    at, total = s, np.zeros(1 << SLICE_BITS, np.uint64)
                total += np.frombuffer(zlib.decompress(counts), np.uint32)
        if at is not None:
            yield closed()

    return run


def lexicon(docs: DataFrame, low: float = BAND[0], high: float = BAND[1]) -> np.ndarray:
    """The bitmap of hashed terms in the band, 2^22 bits, from all rows of docs(text, ...)."""
    texts = docs.select(as_text().alias("text"))
    counts = texts.mapInArrow(_count, "slice int, counts binary")
    slices = 1 << (BITS - SLICE_BITS)
    by_slice = counts.repartition(min(64, slices), "slice").sortWithinPartitions("slice")
    out = np.zeros((slices, (1 << SLICE_BITS) // 8), np.uint8)
    for r in by_slice.mapInArrow(_band(docs.count(), low, high), "slice int, terms binary").collect():
        out[r["slice"]] = np.frombuffer(r["terms"], np.uint8)
    return out.ravel()


def fingerprints(texts: list[str], band: np.ndarray) -> list[str]:
    """One hash for each lexicon subset: of the text's sorted distinct terms in it, nothing where it has none.

    A text without any term in the band gets one hash of all its words in order.
    """
    out = []
    for h in _hashes(texts):
        bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
        terms = np.unique(h[(band[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1])
        if not len(terms):
            out.append("all:" + hashlib.blake2b(h.tobytes(), digest_size=12).hexdigest())
            continue
        held = mix64(terms[None, :] + _SALT[:, None]) >> (np.uint64(64) - DENSITY)[:, None] == 0
        out.append("-".join([hashlib.blake2b(terms[m].tobytes(), digest_size=6).hexdigest() if m.any() else "" for m in held]))
    return out


def likeness(a: str, b: str) -> float:
    """The share of equal hashes among the subsets in which either text has terms; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = a.split("-"), b.split("-")
    if len(x) != len(y):
        return 0.0
    used = [(p, q) for p, q in zip(x, y) if p or q]
    return sum(p == q for p, q in used) / len(used)


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (c.split() for c in _COLUMNS.split(", "))])
_ROLE = pa.schema([*_SCHEMA, ("role", pa.string()), ("part", pa.int64()), ("text", pa.string())])


def _finished(pairs: list[tuple], band: np.ndarray) -> list[tuple]:
    """pairs: ((doc_id, text, fingerprint), (next text, next fingerprint))."""
    edited = []
    for (_, text, _), (after, _) in pairs:
        k = len(text) // 2
        edited.append(text[: len(text) - k] + after[:k])
    out = []
    for ((doc_id, text, mark), (_, next_mark)), e, em in zip(pairs, edited, fingerprints(edited, band)):
        out.append((doc_id, len(text), hashlib.sha256(e.encode()).hexdigest(), mark, em, likeness(mark, em), likeness(mark, next_mark)))
    return out


def _pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, band, last = TaskContext.get().partitionId(), shared.value, None
        empty = (None,) * 4
        for rows in rows_of(batches, "doc_id", "text"):
            rows = [(d, t, f) for (d, t), f in zip(rows, fingerprints([t for _, t in rows], band))]
            out = []
            if last is None:
                _, text, mark = rows[0]
                out.append((None, None, None, mark, *empty[:3], "head", part, text))
            else:
                rows.insert(0, last)
            out += [(*r, "whole", part, None) for r in _finished([(a, b[1:]) for a, b in zip(rows, rows[1:])], band)]
            last = rows[-1]
            yield batch_of(_ROLE, list(zip(*out)))
        if last is not None:
            doc_id, text, mark = last
            yield batch_of(_ROLE, [[x] for x in (doc_id, None, None, mark, *empty[:3], "tail", part, text)])

    return run


def _joined(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "mark", "next_text", "next_mark")]
            rows = _finished([(r[:3], r[3:]) for r in zip(*cols)], shared.value)
            if rows:
                yield batch_of(_SCHEMA, list(zip(*rows)))

    return run


def fingerprint_pairs(docs: DataFrame, low: float = BAND[0], high: float = BAND[1]) -> DataFrame:
    """docs(doc_id, text, ...) -> fingerprints of each text and of the text edited with the next document's start.

    The next document is that of the next doc_id; after the last comes the first. Null ids come first; rows that
    repeat an id follow each other in the order of a hash of their texts. A null text is empty, and an empty one
    has the fingerprint of no words. A lone row follows itself. Other columns are ignored; an empty table gives an
    empty result. One range shuffle of the texts; only the rows at the ends of partitions are joined again.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text"))
    shared = spark.sparkContext.broadcast(lexicon(docs, low, high))
    ranged = in_order(docs, parts_for(docs), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    done = stored(ranged.mapInArrow(_pairs(shared), f"{_COLUMNS}, role string, part long, text string"), "fingerprints")
    parts = sorted(r.part for r in done.where("role = 'head'").select("part").collect())
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next_part long")
    heads = done.where("role = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    tails = done.where("role = 'tail'").select("part", "doc_id", "text", F.col("fingerprint").alias("mark"))
    ends = tails.join(follow, "part").join(heads, "next_part").mapInArrow(_joined(shared), _COLUMNS)
    return done.where("role = 'whole'").select(*_SCHEMA.names).unionByName(ends)
