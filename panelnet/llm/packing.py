"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window, from an index sharded by content.

1. One pass over all texts counts documents by hashed term (2^22 counts, a fixed size), documents, words and bytes:
   every shard weighs terms with the same document frequencies and mean length, those of the whole table.
2. A second pass gives each document its token ids, its terms, and a shard. Documents meet in a shard by a term:
   the one of the least hash among the document's rarest terms that are not noise, which texts that share rare
   terms mostly have in common. A term that many documents hold is salted, so that no shard outgrows a task.
3. A shard's inverted index holds every term that two of its documents share. Its BM25 scores rank the unused
   neighbours of a window's seed; they fill the window, best first, as long as they reach a share of the seed's
   best score. After that, the next unused document goes in and is the seed.

What does not fit is cut and becomes the seed of the next window; the last window of a shard is cut into windows of
powers of two, which need no padding. Shards follow from the texts and ids alone, not from files or partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.llm.common import as_text, batch_of, discard, release, rows_of, slices, stored
from panelnet.llm.word_tokens import forget, id_type, vocabulary_path, word_ids
from panelnet.llm.words import hash_words, mix64, separators

WINDOW = 4096
K1, B = 1.2, 0.75
#: A neighbour goes into a seed's window if it scores at least this share of the seed's best neighbour.
SHARE = 0.4
#: About what a shard, a partition of shards, and a part of a salted term holds. A task has its partition in memory several times
#: over: sorted rows and Arrow batches on both sides.
SHARD_BYTES, SHARD_DOCS, PART_BYTES, SALT_BYTES = 6 << 20, 2048, 16 << 20, 24 << 20
#: Documents of a shard that are compared at a time: their scores are a matrix in memory.
MOST_DOCS = 3072
BITS, SLICE_BITS = 22, 12
#: Slots of a worker's table of words; a full one is begun again; with half as many slots a tenth more CPU time was measured.
TABLE_BITS = 22
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
_SEP = separators(b" \n")
_ONE = np.uint64(1)


# --- statistics of the table -----------------------------------------------------------------------------------


def terms_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text, by text: (term of 32 bits, count, for each text the place of its first term)."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    key, count = np.unique((doc << np.uint64(32)) | (h >> np.uint64(32)), return_counts=True)
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), count, np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs, words, size = np.zeros(1 << BITS, np.uint32), 0, 0, 0
    for part in rows_of(batches, "text"):
        raw = [t.encode() for (t,) in part]
        *_, h, first = hash_words(raw, _SEP)
        doc = np.repeat(np.arange(len(raw), dtype=np.uint64), np.diff(first))
        held = np.sort((doc << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)))
        held = np.sort(held[np.append(True, held[1:] != held[:-1])[: len(held)]] & np.uint64((1 << BITS) - 1))
        ends = np.append(np.flatnonzero(held[1:] != held[:-1]) + 1, len(held))[: len(held)]
        counts[held[ends - 1]] += np.diff(ends, prepend=0).astype(np.uint32)
        docs, words, size = docs + len(raw), words + len(h), size + sum(map(len, raw))
    schema = pa.schema([("slice", pa.int32()), ("places", pa.binary()), ("counts", pa.binary()), ("docs", pa.int64()), ("words", pa.int64()), ("bytes", pa.int64())])
    rows = [(-1, b"", b"", docs, words, size)]
    held = np.flatnonzero(counts)
    cuts = np.searchsorted(held, np.arange((1 << (BITS - SLICE_BITS)) + 1) << SLICE_BITS)
    places, n = (held & ((1 << SLICE_BITS) - 1)).astype("<u2"), counts[held].astype("<u4")
    rows += [(s, places[a:b].tobytes(), n[a:b].tobytes(), 0, 0, 0) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    yield batch_of(schema, list(zip(*rows)))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])
    at, total = None, None
    for batch in batches:
        for s, places, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "places", "counts"))):
            if s != at:
                if at is not None:
                    yield batch_of(schema, [[at], [_coded(total).tobytes()]])
                at, total = s, np.zeros(1 << SLICE_BITS, np.uint64)
            total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<u4")
    if at is not None:
        yield batch_of(schema, [[at], [_coded(total).tobytes()]])


def _coded(counts: np.ndarray) -> np.ndarray:
    """Counts to three digits in two bytes, on a logarithmic scale."""
    return np.rint(1024 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint16)


class Statistics(NamedTuple):
    """Document frequencies by hashed term, coded, and the table's documents, words and bytes."""

    coded: np.ndarray
    docs: int
    words: int
    bytes: int
    #: Twice what a hashed term mostly holds by chance, plus 2: a count below tells nothing of its terms.
    noise: float

    def frequency(self, terms: np.ndarray) -> np.ndarray:
        """Documents that hold a term or another of the same hash."""
        return np.exp2(self.coded[terms >> np.uint32(32 - BITS)] / 1024.0) - 1

    def idf(self, terms: np.ndarray) -> np.ndarray:
        f = np.minimum(self.frequency(terms), self.docs)
        return np.log1p((self.docs - f + 0.5) / (f + 0.5))

    def mean_words(self) -> float:
        return max(self.words / max(self.docs, 1), 1.0)

    def shards(self) -> int:
        return max(1, -(-self.bytes // SHARD_BYTES), -(-self.docs // SHARD_DOCS))


def statistics(docs: DataFrame) -> Statistics:
    """Counts over all rows of docs(text, ...); the driver gets 8 MB of coded counts, whatever the table's size."""
    counts = stored(docs.select(as_text().alias("text")).mapInArrow(_count, "slice int, places binary, counts binary, docs long, words long, bytes long"), "counts")
    totals = counts.where("slice < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("docs", "words", "bytes"))).first()
    slices = 1 << (BITS - SLICE_BITS)
    by_slice = counts.where("slice >= 0").select("slice", "places", "counts").repartition(16, "slice").sortWithinPartitions("slice")
    coded = np.zeros((slices, 1 << SLICE_BITS), np.uint16)
    for r in by_slice.mapInArrow(_summed, "slice int, counts binary").collect():
        coded[r["slice"]] = np.frombuffer(r["counts"], np.uint16)
    discard(counts)
    return Statistics(coded.ravel(), *map(int, totals), 2 * float(np.exp2(np.median(coded) / 1024.0) - 1) + 2)


# --- shards by content -----------------------------------------------------------------------------------------


def keys_of(stats: Statistics, terms: np.ndarray, first: np.ndarray, sizes: list[int], salts: np.ndarray) -> np.ndarray:
    """For each text a number of 63 bits, equal for texts that share their rarest terms; hot terms are salted."""
    n = len(first) - 1
    f = stats.frequency(terms)
    low = stats.noise
    octave = np.where(f >= low, np.floor(np.log2(np.maximum(f, low) / low) / 3), 20).astype(np.uint64)
    rank = (octave << np.uint64(58)) | (mix64(terms.astype(np.uint64) + _ONE) >> np.uint64(6))
    key, load = np.zeros(n, np.uint64), np.full(n, float(stats.docs))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        starts = first[some]
        best = np.minimum.reduceat(rank, starts)
        at = np.flatnonzero(rank == np.repeat(best, np.diff(np.append(starts, len(rank)))))
        key[some] = mix64(best + _ONE)
        load[some] = f[at[np.searchsorted(at, starts)]]
    parts = np.ceil(load * (stats.bytes / max(stats.docs, 1)) / SALT_BYTES).astype(np.uint64)
    salted = np.where(parts > 1, salts % np.maximum(parts, _ONE), 0).astype(np.uint64)
    return mix64(key + salted * np.uint64(0x9E3779B97F4A7C15)) >> _ONE


def _salts(ids: list, texts: list[str]) -> np.ndarray:
    """A hash of each row's id and text; equal rows that follow each other are told apart by their count."""
    seen: dict[int, int] = {}
    out = []
    for d, t in zip(ids, texts):
        h = xxhash.xxh3_64_intdigest(f"{d}:{len(t)}:{t[:64]}".encode())
        seen[h] = k = seen.get(h, -1) + 1
        out.append((h + k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return np.array(out, np.uint64)


_DEALT = "shard long, key long, doc_id long, tie long, n_words long, ids binary, terms binary, counts binary"
_DEALT_ARROW = pa.schema([("shard", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n_words", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary())])


def _dealt(shared, vocabulary: str, end: int):
    """Rows with token ids, the terms that other documents may hold, and a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, coder = shared.value, word_ids(vocabulary, TABLE_BITS)
        shards = stats.shards()
        for part in rows_of(batches, "doc_id", "text"):
            if coder.full():
                coder.clear()
            ids, texts = map(list, zip(*part))
            number, h, first, sizes = coder.numbers(texts)
            flat, length = coder.rows.gather(number)
            ends = np.concatenate([[0], np.cumsum(length)])[first]
            terms, count, at = terms_of(h, first)
            key = keys_of(stats, terms, at, sizes, _salts(ids, texts))
            shard = ((key >> np.uint64(31)) * np.uint64(shards)) >> np.uint64(32)
            known = stats.coded[terms >> np.uint32(32 - BITS)] > 1024  # a count above one
            places = np.concatenate([[0], np.cumsum(known)])[at]
            terms, count = terms[known], np.minimum(count[known], 65535).astype("<u2")
            flat = flat.astype(id_type(vocabulary, end))
            tail = np.array([end], flat.dtype).tobytes()
            rows = (
                shard.astype(np.int64), key.astype(np.int64), ids, [xxhash.xxh3_64_intdigest(t) >> 1 for t in texts], np.diff(first),
                [flat[a:b].tobytes() + tail for a, b in zip(ends[:-1], ends[1:])],
                [terms[a:b].tobytes() for a, b in zip(places[:-1], places[1:])], [count[a:b].tobytes() for a, b in zip(places[:-1], places[1:])],
            )
            yield batch_of(_DEALT_ARROW, list(rows))

    return run


# --- the index of a shard --------------------------------------------------------------------------------------


def scores(stats: Statistics, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """BM25 scores (query, document) of a shard's documents for one another; the diagonal is -1.

    Terms of one document alone score nothing and are left out. Posting lists of frequent terms are columns of a
    matrix product, those of rare ones are paired posting by posting.
    """
    n = len(terms)
    out = np.zeros((n, n), np.float32)
    row = np.repeat(np.arange(n, dtype=np.uint32), [len(t) for t in terms])
    term = np.concatenate(terms) if n else np.empty(0, np.uint32)
    tf = (np.concatenate(counts) if n else np.empty(0)).astype(np.float64)
    order = np.argsort(term, kind="stable")
    term, row, tf = term[order], row[order].astype(np.int64), tf[order]
    start = np.flatnonzero(np.diff(term, prepend=term[:1] ^ np.uint32(1)))
    df = np.diff(np.append(start, len(term)))
    norm = K1 * (1 - B + B * lengths / stats.mean_words())
    weight = np.repeat(stats.idf(term[start]), df) * tf * (K1 + 1) / (tf + norm[row])
    many = max(32, n // 32)
    common = np.flatnonzero(df > many)
    for at in range(0, len(common), 512):
        some = common[at : at + 512]
        held, worth = (np.zeros((n, len(some)), np.float32) for _ in range(2))
        for c, k in enumerate(some):
            p = slice(start[k], start[k] + df[k])
            held[row[p], c] = 1
            worth[row[p], c] = weight[p]
        out += held @ worth.T
    rare = np.repeat((df > 1) & (df <= many), df)
    left = np.repeat(start + df, df)[rare] - np.flatnonzero(rare) - 1
    row, weight = row[rare], weight[rare]
    weight = weight.astype(np.float32)
    flat = out.reshape(-1)
    here, step = np.flatnonzero(left >= 1), 1
    while len(here):  # postings that are `step` places apart in one list
        a, b = row[here], row[here + step]
        np.add.at(flat, a * n + b, weight[here + step])
        np.add.at(flat, b * n + a, weight[here])
        step += 1
        here = here[left[here] >= step]
    np.fill_diagonal(out, -1)
    return out


class Packer:
    """Fills windows with the documents of a shard, chunk by chunk."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.open: list[tuple] = []
        self.room = window
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, end in pieces:
            crc = zlib.crc32(ids[start:end].astype("<u4").tobytes())
            self.out.append((doc_id, start, end - start, crc, len(ids), self.sequence, offset))
            offset += end - start
        self.sequence += 1

    def take(self, doc_id: int | None, ids: np.ndarray, start: int) -> bool:
        """Put ids[start:] into the open window and, cut, into the next; whether it began the window now open."""
        fresh = False
        while start < len(ids):
            n = min(self.room, len(ids) - start)
            self.open.append((doc_id, ids, start, start + n))
            self.room -= n
            start += n
            fresh = len(self.open) == 1
            if not self.room:
                self._close(self.open)
                self.open, self.room, fresh = [], self.window, False
        return fresh

    def pack(self, docs: list[tuple], stats: Statistics, share: float = SHARE) -> list[tuple[int, int]]:
        """docs: (doc_id, ids, terms, counts, words). Returns (seed, neighbour) for each document that a seed drew."""
        items = []
        for doc_id, ids, terms, counts, words in docs:
            whole = len(ids) // self.window * self.window
            for at in range(0, whole, self.window):
                self._close([(doc_id, ids, at, at + self.window)])
            if whole < len(ids):
                items.append((doc_id, ids, whole, terms, counts, words))
        like = scores(stats, [i[3] for i in items], [i[4] for i in items], np.array([i[5] for i in items], np.float64))
        least = like.max(axis=1, initial=0) * share
        used, after, seed, drawn = np.zeros(len(items), bool), 0, -1, []
        for _ in range(len(items)):
            j = -1
            if seed >= 0 and self.open:
                rest = np.where(used, -1, like[seed])
                j = int(rest.argmax())
                if rest[j] <= 0 or rest[j] < least[seed]:
                    j = -1
                else:
                    drawn.append((seed, j))
            if j < 0:
                while used[after]:
                    after += 1
                seed = j = after
            used[j] = True
            if self.take(*items[j][:3]):
                seed = j
        return drawn

    def finish(self) -> None:
        """Cut the last window into windows of powers of two."""
        used, rest = self.window - self.room, list(self.open)
        while used:
            size = 1 << (used.bit_length() - 1)
            used -= size
            pieces = []
            while size:
                doc_id, ids, start, end = rest.pop(0)
                n = min(size, end - start)
                pieces.append((doc_id, ids, start, start + n))
                size -= n
                if start + n < end:
                    rest.insert(0, (doc_id, ids, start + n, end))
            self._close(pieces)
        self.open, self.room = [], self.window

    def taken(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return batch_of(_ARROW, list(zip(*out)) or [[]] * len(_ARROW))


def _packed(shared, width: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        stats, at, packer, held, size = shared.value, None, None, [], 0

        def full() -> bool:
            return len(held) >= MOST_DOCS or size >= SHARD_BYTES

        for batch in slices(batches, "ids"):
            columns = [batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids", "terms", "counts", "n_words")]
            for shard, doc_id, ids, terms, counts, words in zip(*columns):
                if shard != at or full():
                    if packer:
                        packer.pack(held, stats)
                        held, size = [], 0
                    if shard != at:
                        if packer:
                            packer.finish()
                            yield packer.taken()
                        at, packer = shard, Packer(window, shard << 32)
                held.append((doc_id, np.frombuffer(ids, width), np.frombuffer(terms, "<u4"), np.frombuffer(counts, "<u2"), words))
                size += len(ids)
        if packer:
            packer.pack(held, stats)
            packer.finish()
            yield packer.taken()
        release()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = 2, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) -> pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is the end id alone. Null and repeated ids and repeated rows are packed as documents of
    their own; other columns are ignored; an empty table gives no piece. Texts of any length are cut at window
    ends; their remainder takes part with the terms of the whole text. Documents that score the same for a seed
    are taken in the order of their shard: by content key, doc_id (null first) and a hash of the text. Every sequence
    has `window` ids, or a power of two of them, so none is padded. The result is the same however docs is dealt to
    files and partitions, but for rows that are equal in id and text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text"))
    vocabulary = vocabulary or vocabulary_path()
    stats = statistics(docs)
    shared = spark.sparkContext.broadcast(stats)
    shards = stats.shards()
    parts = max(1, min(shards, -(-shards * SHARD_BYTES // PART_BYTES)))
    dealt = docs.mapInArrow(_dealt(shared, vocabulary, end), _DEALT)
    dealt = dealt.repartitionById(parts, F.expr(f"cast(shard * {parts} div {shards} as int)")).sortWithinPartitions("shard", "key", "doc_id", "tie")
    return dealt.mapInArrow(_packed(shared, id_type(vocabulary, end), window), SCHEMA)
