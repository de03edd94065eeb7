"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelnet.llm.common import as_text, batch_of, release, rows_of, slices
from panelnet.llm.ftrl import Ftrl, margin, sigmoid
from panelnet.llm.words import hash_words, mix64, separators

BITS = 20
#: At most so many labelled rows are learnt from, those with the least hash of their id.
MOST_LABELLED = 16_000
#: A feature counts if so many different rows of the sample have it; copies of a text are one row.
LEAST_ROWS = 5
_SEP = separators(bytes(c for c in range(128) if not chr(c).isalnum()))


def features(texts: list[str]) -> list[np.ndarray]:
    """For each text the numbers of its words, adjacent pairs and pairs one word apart, with repeats."""
    *_, h, first = hash_words([t.lower().encode() for t in texts], _SEP)
    out = []
    for w in np.split(h, first[1:-1]):
        pair = mix64(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])
        skip = mix64(w[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:])
        out.append((np.concatenate([w, pair, skip]) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def held_out() -> Column:
    """The rows that are never learnt from: crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("row", pa.binary())])
    for part in rows_of(batches, "doc_id", "label", "text"):
        rows = [np.unique(r).astype(np.int32).tobytes() for r in features([t for *_, t in part])]
        yield batch_of(schema, [[p[0] for p in part], [p[1] for p in part], rows])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, least_rows: int = LEAST_ROWS) -> np.ndarray:
    """Weights from labelled rows of docs that are not held out: of those, the `most` with the least hash of doc_id.

    labels(doc_id, toxic); rows with a null id or label, and ids that docs lacks, count for nothing; an id with
    several labels has the largest. Without labels of both kinds all weights are 0 and every score is 0.5. The
    features of fewer than least_rows different sample rows have no weight: those of a handful of rows tell little of
    others, whatever the table's size. The sample is bounded, so is the task that learns: `most` rows of features; the driver gets the weights that are not 0.
    """
    labelled = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    sample = labelled.where(~held_out()).join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")).join(F.broadcast(sample), "doc_id")
    rows = texts.mapInArrow(_featured, "doc_id long, label int, row binary")
    out = np.zeros((1 << BITS) + 1, np.float32)
    for r in rows.repartition(1).mapInArrow(_learner(least_rows), "at array<int>, weights array<float>").collect():
        out[r["at"]] = r["weights"]
    return out


def _learner(least_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The weights that are not 0, learnt in one task from the bounded sample in the order of a hash of its rows."""
        votes: dict[bytes, list[int]] = {}
        for batch in batches:
            for row, label in zip(batch.column("row").to_pylist(), batch.column("label").to_pylist()):
                votes.setdefault(row, []).append(label)
        order = sorted(votes, key=lambda r: (xxhash.xxh3_64_intdigest(r), r))
        marks = [float(2 * sum(votes[r]) >= len(votes[r])) for r in order]
        if len(set(marks)) < 2:
            return
        df = np.zeros(1 << BITS, np.int32)
        for r in order:
            df[np.frombuffer(r, np.int32)] += 1
        rows = [(x := np.frombuffer(r, np.int32))[df[x] >= least_rows] for r in order]
        at, weights = _packed(Ftrl(BITS, alpha=2.0, l1=5.0).fit(rows, marks, epochs=3).weights())
        del votes, order, rows
        release()
        schema = pa.schema([("at", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32()))])
        yield batch_of(schema, [[at], [weights]])

    return run


def _packed(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(weights)
    return at.astype(np.int32), weights[at]


def _opened(packed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[packed[0]] = packed[1]
    return out


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted), a row for a row.

    A null or empty text has the bias alone. Null and repeated ids and repeated rows are scored row by row; other
    columns are ignored; an empty table gives an empty result. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_packed(weights))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _opened(shared.value)
        for part in rows_of(batches, "doc_id", "held_out", "text"):
            s = [sigmoid(margin(r, w)) for r in features([t for *_, t in part])]
            yield batch_of(schema, [[p[0] for p in part], [p[1] for p in part], s, [int(x >= 0.5) for x in s]])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), as_text().alias("text"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def not_toxic(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; all rows where nothing was learnt.

    A null or empty text has the score of the bias alone. Rows without an id or with a repeated one, and repeated rows,
    are kept or not each by its text; an empty table gives an empty result. Long texts are taken a few at a time.
    """
    if not weights.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(_packed(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _opened(shared.value)
        for batch in slices(batches, "text"):
            keep = [sigmoid(margin(r, w)) < threshold for r in features([t or "" for t in batch.column("text").to_pylist()])]
            yield batch.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
