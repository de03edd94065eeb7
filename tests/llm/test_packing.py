"""Packing: pieces against the library, BM25 against its formula, neighbours against an index of the whole table."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelnet.llm import packing, word_tokens
from panelnet.llm.words import hash_words

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def _term(word):
    return int(hash_words([word.encode()], packing._SEP)[3][0]) >> 32


def _dealt(spark, docs, stats):
    shared = spark.sparkContext.broadcast(stats)
    rows = docs.mapInArrow(packing._dealt(shared, word_tokens.vocabulary_path(), 2), packing._DEALT).orderBy("shard", "key", "doc_id", "tie").collect()
    return [(r.shard, r.doc_id, np.frombuffer(r.ids, "<u2"), np.frombuffer(r.terms, "<u4"), np.frombuffer(r.counts, "<u2"), r.n_words) for r in rows]


@pytest.mark.parametrize("size", [20_000, 6 << 20])
def test_pieces(spark, monkeypatch, size):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    coder = word_tokens.word_ids(word_tokens.vocabulary_path()).library
    stats = packing.statistics(docs.select("text"))
    assert (stats.docs, stats.bytes) == (len(texts), sum(len(t.encode()) for t in texts.values()))
    rows = _dealt(spark, docs, stats)
    packer = packing.Packer(4096, 0)
    for at in range(0, len(rows), size // 500):
        packer.pack([r[1:] for r in rows[at : at + size // 500]], stats)
    packer.finish()
    got = packer.out if size < 1 << 20 else [tuple(r) for r in packing.pack(docs).collect()]
    pieces, fill = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, total, sequence, offset in got:
        pieces[doc_id].append((start, length, crc, total))
        fill[sequence].append((offset, length))
    for d, t in texts.items():
        ids, at = np.array([*coder.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for start, length, crc, total in sorted(pieces[d]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    for s in fill.values():
        n = 0
        for offset, length in sorted(s):
            assert offset == n
            n += length
        assert n == 4096 or n & (n - 1) == 0


def test_a_task_holds_a_small_part_of_the_shards(spark):
    """Partitions of 48 MB took an executor beyond its memory, as a task holds its partition several times over."""
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    stats = packing.statistics(docs.select("text"))
    parts = packing.pack(docs).rdd.getNumPartitions()
    assert stats.shards() > 3 and stats.shards() / parts * packing.SHARD_BYTES <= (16 << 20) + packing.SHARD_BYTES


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b = (sorted(map(tuple, packing.pack(d).collect())) for d in (docs, docs.repartition(9)))
    assert a == b


def _corpus(n, seed=3):
    r = random.Random(seed)
    return [" ".join([r.choice(["the", "of", "and", "in"]) for _ in range(r.randrange(1, 9))] + [f"w{r.randrange(60)}" for _ in range(r.randrange(0, 30))]) for _ in range(n)]


def test_frequencies_and_scores_by_the_formula(spark):
    texts = [*_corpus(150), "", "the the the", "alone"]
    stats = packing.statistics(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    held = Counter(w for t in texts for w in set(t.split()))
    words = [t.split() for t in texts]
    mean = sum(map(len, words)) / len(words)
    assert (stats.docs, stats.words) == (len(texts), sum(map(len, words))) and stats.mean_words() == mean
    for w, n in held.items():
        assert abs(stats.frequency(np.array([_term(w)], np.uint32))[0] - n) < 0.01 * n  # no two share a hash here
    *_, h, first = hash_words([t.encode() for t in texts], packing._SEP)
    terms, count, at = packing.terms_of(h, first)
    rows = [(terms[a:b], count[a:b]) for a, b in zip(at[:-1], at[1:])]
    got = packing.scores(stats, [t for t, _ in rows], [c for _, c in rows], np.array([len(w) for w in words], float))
    n = len(texts)
    for q in range(n):
        for d in range(n):
            tf = Counter(words[d])
            want = sum(
                math.log1p((n - held[t] + 0.5) / (held[t] + 0.5)) * tf[t] * (packing.K1 + 1) / (tf[t] + packing.K1 * (1 - packing.B + packing.B * len(words[d]) / mean))
                for t in set(words[q]) & set(words[d])
            )
            assert q == d and got[q, d] == -1 or abs(got[q, d] - want) <= 0.01 * want + 1e-5


def test_windows_are_filled_by_the_best_unused(spark):
    texts = _corpus(120, 5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    stats = packing.statistics(docs)
    rows = [r[1:] for r in _dealt(spark, docs, stats)]
    packer = packing.Packer(256, 0)
    drawn = packer.pack(rows, stats)
    packer.finish()
    like = packing.scores(stats, [r[2] for r in rows], [r[3] for r in rows], np.array([r[4] for r in rows], float))
    place, began = {r[0]: i for i, r in enumerate(rows)}, {}
    for k, (doc_id, start, *_) in enumerate(packer.out):
        began.setdefault(place[doc_id], k)
    order = sorted(began, key=began.get)  # documents by when they were taken
    used = set()
    by_seed = {j: s for s, j in drawn}
    assert len(drawn) > 60
    for j in order:
        if j in by_seed:
            s = by_seed[j]
            free = [k for k in range(len(rows)) if k not in used]
            assert like[s, j] == max(like[s, k] for k in free) >= packing.SHARE * like[s].max() - 1e-6
        used.add(j)


def test_topic_mates_share_sequences(spark):
    """Documents of a topic stand far apart in the table; a plain order would put none of them together."""
    r = np.random.default_rng(2)
    texts = []
    for i in range(4000):
        topic = i % 1000
        texts.append(" ".join([f"t{topic}x{k}" for k in r.integers(0, 40, 60)] + [f"c{k}" for k in r.integers(0, 300, 60)]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartitionByRange(8, "doc_id")
    by = defaultdict(set)
    for p in packing.pack(docs, window=2048).collect():
        by[p.sequence_id].add(p.doc_id)
    met = {a for s in by.values() for a in s if any(b != a and b % 1000 == a % 1000 for b in s)}
    assert len(met) > 0.8 * len(texts)


def test_neighbours_against_an_index_of_the_table(spark):
    """Of the documents, how many have a neighbour in their shard that scores as well as the best of the table."""
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    stats = packing.statistics(docs)
    rows = _dealt(spark, docs, stats)
    assert stats.shards() > 3
    shard, terms, counts = np.array([r[0] for r in rows]), [r[3] for r in rows], [r[4] for r in rows]
    lengths = np.array([r[5] for r in rows], float)
    flat, row = np.concatenate(terms), np.repeat(np.arange(len(rows)), [len(t) for t in terms])
    known, number = np.unique(flat, return_inverse=True)
    tf = np.concatenate(counts).astype(float)
    weight = stats.idf(known)[number] * tf * (packing.K1 + 1) / (tf + (packing.K1 * (1 - packing.B + packing.B * lengths / stats.mean_words()))[row])
    order = np.argsort(number, kind="stable")
    ends = np.searchsorted(number[order], np.arange(len(known) + 1))
    share, near = [], []
    for q in np.random.default_rng(0).choice(len(rows), 400, replace=False):
        mine = number[row == q]
        at = np.concatenate([order[ends[t] : ends[t + 1]] for t in mine]) if len(mine) else np.empty(0, int)
        score = np.bincount(row[at], weight[at], len(rows)) if len(at) else np.zeros(len(rows))
        own, score[q] = score[q], -1
        if score.max() > 0:
            share.append(score[shard == shard[q]].max() / score.max())
            if score.max() > 0.5 * own:
                near.append(share[-1])
    assert np.mean(share) > 0.9 and np.mean(np.array(near) > 0.99) > 0.8 and len(near) > 50


def test_hot_terms_are_salted(spark):
    """A third of the rows are copies: they are dealt to many shards, each of which holds their mates."""
    stats = packing.Statistics(np.full(1 << packing.BITS, packing._coded(np.array([1_000_000])), np.uint16), 3_000_000, 900_000_000, 6_000_000_000, 4.0)
    terms = np.tile(np.array([5, 9, 77], np.uint32), 1000)
    keys = packing.keys_of(stats, terms, np.arange(0, 3003, 3), [], packing._salts(list(range(1000)), ["same"] * 1000))
    assert 20 < len(set(keys.tolist())) < 100
    same = packing.keys_of(stats, terms, np.arange(0, 3003, 3), [], packing._salts([None] * 1000, ["same"] * 1000))
    assert len(set(same.tolist())) > 20
