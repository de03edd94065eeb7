"""A quality classifier by co-training: a view of the text and a view of the metadata teach each other.

Both views are sparse logistic regressions over hashed categories. In each round either view labels the unlabelled
documents it is surest about, as many of each kind as the labels' shares allow, for the other view to learn from.
Each view is then calibrated (a logistic curve on a fold it never learnt from), and a logistic regression over both
calibrated margins, fitted on the same fold, scores every document.

What is learnt from is a bounded sample; all documents are scored.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.llm.common import as_text, batch_of, rows_of
from panelnet.llm.ftrl import Ftrl
from panelnet.llm.words import ASCII_SPACE, hash_words, mix64, separators

BITS = 18
#: Bounds of the sample: labelled and unlabelled documents, those with the least hash of their id.
MOST_LABELLED, MOST_UNLABELLED = 6_000, 4_000
ROUNDS, POOL_SHARE, SURE = 4, 0.05, 0.95
_WORD = separators(bytes(c for c in range(128) if not chr(c).isalnum()))
_MARK = separators(ASCII_SPACE + bytes(c for c in range(128) if chr(c).isalnum()) + bytes(range(128, 256)))


def _feature(kind: int | np.ndarray, values) -> np.ndarray:
    v = np.asarray(values).astype(np.int64).view(np.uint64)
    kinds = np.asarray(kind, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix64(v + kinds) >> np.uint64(64 - BITS)).astype(np.int32)


def _steps(x: np.ndarray) -> np.ndarray:
    """Halves of a power of two; -40 for 0 and below."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, np.floor(2 * np.log2(x)), -40).astype(np.int64)


def _rows(doc: np.ndarray, feature: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct features of each of n documents."""
    key = np.unique((doc.astype(np.int64) << BITS) | feature)
    return np.split((key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key, np.arange(1, n) << BITS))


def _counted(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of n documents has."""
    order = np.lexsort((h, doc))
    d, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.bincount(d[new], minlength=n)


@lru_cache(1)
def _capital_table() -> np.ndarray:
    return np.array([not 0xD800 <= i < 0xE000 and chr(i).isupper() for i in range(sys.maxunicode + 1)])


def _capitals(texts: list[str], length: np.ndarray) -> np.ndarray:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.concatenate([[0], np.cumsum(_capital_table()[codes])])
    ends = np.cumsum(length)
    return total[ends] - total[ends - length]


def text_view(texts: list[str]) -> list[np.ndarray]:
    """Words, runs of marks, and steps of their ratios: marks, capitals, repetition, word and line length."""
    n, raw = len(texts), [t.encode() for t in texts]
    *_, w, at_w = hash_words(raw, _WORD)
    *_, m, at_m = hash_words(raw, _MARK)
    words, marks = np.diff(at_w), np.diff(at_m)
    of_w, of_m = np.repeat(np.arange(n), words), np.repeat(np.arange(n), marks)
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    length, count = (np.fromiter(map(len, x), np.int64, n) for x in (texts, lines))
    apart = np.fromiter((len(set(x)) for x in lines), np.int64, n)
    some = np.maximum(words, 1)
    ratios = np.stack([marks / some, _capitals(texts, length) / np.maximum(length, 1), _counted(of_w, w, n) / some, length / some, apart / np.maximum(count, 1), _counted(of_m, m, n) / np.maximum(marks, 1)])
    kinds = np.repeat(np.arange(2, 8), n)
    docs = np.concatenate([of_w, of_m, np.tile(np.arange(n), 6)])
    return _rows(docs, np.concatenate([_feature(0, w.view(np.int64)), _feature(1, m.view(np.int64)), _feature(kinds, _steps(ratios).ravel())]), n)


@lru_cache(1 << 14)
def _code(value: str) -> int:
    return int(hash_words([value.encode()], separators(b"\n"))[3].view(np.int64)[:1].sum())


def meta_view(rows: list[tuple], columns: list[str]) -> list[np.ndarray]:
    """Categories of the page's metadata columns, numbers by steps; rows: values by column."""
    n = len(rows)
    values = [[_steps(np.array([v], float))[0] if isinstance(v, (int, float)) else _code(str(v)) for v in column] for column in zip(*rows)]
    kinds = np.repeat(np.arange(40, 40 + len(values)), n)
    return _rows(np.tile(np.arange(n), len(values)), _feature(kinds, np.array(values, np.int64).ravel()), n)


def _views(batch_rows: list[tuple], columns: list[str]) -> tuple[list, list]:
    """rows: metadata by column, then the text. Nothing of the text is in the metadata view."""
    return text_view([r[-1] for r in batch_rows]), meta_view([r[:-1] for r in batch_rows], columns)


def margins(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """For each row of distinct features the sum of their weights and the bias."""
    total = np.concatenate([[0.0], np.cumsum(weights[np.concatenate(rows)] if rows else [], dtype=np.float64)])
    ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
    return total[ends] - total[ends - [len(r) for r in rows]] + float(weights[-1]) if rows else np.empty(0)


def _platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic regression of y on the columns of x, by damped Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Weights of both views, their calibrations, and the weights of the combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, curves: list[np.ndarray], joint: np.ndarray):
        self.text, self.meta, self.curves, self.joint = text, meta, curves, joint

    def scores(self, texts: list[np.ndarray], metas: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text, metadata) probabilities of good quality of rows of both views."""
        x = [c[0] * margins(r, w) + c[1] for r, w, c in zip((texts, metas), (self.text, self.meta), self.curves)]
        return _sigmoid(self.joint[0] * x[0] + self.joint[1] * x[1] + self.joint[2]), _sigmoid(x[0]), _sigmoid(x[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def cotrain(views: list[tuple[np.ndarray, np.ndarray]], labels: list[int | None], rounds: int = ROUNDS, pool_share: float = POOL_SHARE) -> Model:
    """views: (text features, metadata features); labels: 0, 1 or None. Every fifth labelled row only calibrates.

    In a round a view labels at most pool_share of the unlabelled rows, the surest first, ties by their order; the
    view that goes first may take a row that the other is sure of, too. With labels of one kind every score is 0.5.
    """
    known = [i for i, y in enumerate(labels) if y is not None]
    fold, learnt = known[::5], [i for k, i in enumerate(known) if k % 5]
    kinds = {labels[i] for i in learnt}
    flat = np.zeros((1 << BITS) + 1, np.float32)
    if len(kinds) < 2:
        return Model(flat, flat, [np.array([1.0, 0.0])] * 2, np.array([0.0, 0.0, 0.0]))
    share = sum(labels[i] for i in learnt) / len(learnt)
    sets = [{i: labels[i] for i in learnt} for _ in range(2)]
    pool = np.array([i for i, y in enumerate(labels) if y is None], int)
    each = max(1, round(len(pool) * pool_share))
    weights = [flat, flat]
    for r in range(rounds + 1):
        weights = [Ftrl(BITS, l1=0.5).fit([views[i][v] for i in s], list(s.values())).weights() for v, s in enumerate(sets)]
        if r == rounds or not len(pool):
            break
        taught = set()
        for v in range(2):
            p = _sigmoid(margins([views[i][v] for i in pool], weights[v]))
            for y, sure, most in ((1, p, max(1, round(each * share))), (0, 1 - p, max(1, round(each * (1 - share))))):
                order = np.lexsort((pool, -sure))
                got = [int(pool[k]) for k in order[sure[order] >= SURE] if int(pool[k]) not in taught][:most]
                sets[1 - v].update(dict.fromkeys(got, y))
                taught.update(got)
        pool = np.array([i for i in pool if int(i) not in taught], int)
    y = np.array([labels[i] for i in fold], float)
    m = np.column_stack([margins([views[i][v] for i in fold], weights[v]) for v in range(2)])
    curves = [_platt(m[:, [v]], y) for v in range(2)]
    return Model(*weights, curves, _platt(np.column_stack([curves[v][0] * m[:, v] + curves[v][1] for v in range(2)]), y))


def train(docs: DataFrame, labels: DataFrame, columns: list[str], most: tuple[int, int] = (MOST_LABELLED, MOST_UNLABELLED)) -> Model:
    """Learn from at most most[0] labelled and most[1] unlabelled documents, those with the least hash of doc_id.

    labels(doc_id, quality); null ids and labels, and ids that docs lacks, count for nothing, an id with several labels has the largest.
    The sample is bounded, and so is the task that learns; the driver gets the model.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[0])
    free = ids.join(known.select("doc_id"), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[1])
    sample = chosen.unionByName(free.distinct().withColumn("label", F.lit(None).cast("int")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns, as_text().alias("text")).join(F.broadcast(sample), "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, "doc_id", "label", *columns, "text"):
            a, b = _views([p[2:] for p in part], columns)
            yield batch_of(schema, [[p[0] for p in part], [p[1] for p in part], [x.tobytes() for x in a], [x.tobytes() for x in b]])

    featured = rows.mapInArrow(run, "doc_id long, label int, a binary, b binary")
    got = featured.repartition(1).mapInArrow(_learnt, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else cotrain([], [])


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model, learnt in one task from the bounded sample in the order of a hash of its rows."""
    got = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("a", "b", "doc_id", "label")))]
    got.sort(key=lambda r: (xxhash.xxh3_64_intdigest(r[0]), r[:3]))
    views = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b, *_ in got]
    yield batch_of(pa.schema([("model", pa.binary())]), [[pickle.dumps(cotrain(views, [r[3] for r in got]))]])


def metadata(docs: DataFrame) -> list[str]:
    """The metadata columns: source and lang, where docs has them."""
    return [c for c in ("source", "lang") if c in docs.columns]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, source, lang, ...) -> (doc_id, score, text_score, meta_score, predicted), a row for a row.

    Scores are probabilities of good quality. A null text counts as empty, null metadata as a value of its own.
    Null and repeated ids and repeated rows are scored row by row, equal rows alike; columns beyond the metadata are ignored; an
    empty table gives an empty result. Texts are read whole.
    """
    columns = metadata(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in rows_of(batches, "doc_id", *columns, "text"):
            got = m.scores(*_views([p[1:] for p in part], columns))
            yield batch_of(schema, [[p[0] for p in part], *got, (got[0] >= 0.5).astype(np.int32)])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns, as_text().alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, text_score double, meta_score double, predicted int")
