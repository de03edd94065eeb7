"""Each operator against a plain version, or held-out accuracy, on the small tables."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelnet.llm import cotraining, imatch, near_dup, packing, queries, quality_rules, surrogates, token_records, toxicity, word_tokens
from panelnet.llm.ftrl import Ftrl, margin

SMALL, MID, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_imatch_edits_and_likeness(spark, texts):
    got = {r.doc_id: r for r in queries.op1_imatch_fingerprints(spark, SMALL).collect()}
    ids = sorted(texts)
    for d, n in zip(ids, ids[1:] + ids[:1]):
        k = len(texts[d]) // 2
        edited = texts[d][: len(texts[d]) - k] + texts[n][:k]
        assert got[d].n_chars == len(texts[d]) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].near_next == imatch.likeness(got[d].fingerprint, got[n].fingerprint)
        assert got[d].near_edited == imatch.likeness(got[d].fingerprint, got[d].edited_fingerprint)
    marks = {}
    for d in ids:
        assert marks.setdefault(texts[d], got[d].fingerprint) == got[d].fingerprint


def test_imatch_band_and_fingerprints_by_hand(spark):
    docs = [(i, " ".join(["all"] + [f"w{j}" for j in range(50) if (i * 7 + j) % (j % 9 + 2) == 0] + [f"rare{i}"])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    band = imatch.lexicon(df, 0.05, 0.3)
    count = Counter(w for _, t in docs for w in set(t.split()))
    for w, n in count.items():
        bucket = int(imatch._hashes([w])[0][0]) >> (64 - imatch.BITS)
        assert bool(band[bucket >> 3] >> (7 - bucket % 8) & 1) == (15 <= n <= 90)
    a, b = imatch.fingerprints([docs[0][1], " ".join(reversed(docs[0][1].split())) + " all"], band)
    assert a == b and imatch.likeness(a, a) == 1.0


def test_near_copies_are_liker_than_strangers(spark):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefgh") + r.choice("ijklm") + r.choice("nopqrst") for _ in range(200)) for _ in range(200)]
    band = imatch.lexicon(spark.createDataFrame(list(enumerate(base)), "doc_id long, text string"), 0.1, 0.6)
    near, far = [], []
    for i, t in enumerate(base[:60]):
        w = t.split()
        w[5] = "zzz"
        x, y, z = imatch.fingerprints([t, " ".join(w), base[i + 1]], band)
        near.append(imatch.likeness(x, y))
        far.append(imatch.likeness(x, z))
    assert np.mean(near) > 0.8 and np.mean(far) < 0.1


def _accuracy(spark, got, column, at=MID):
    marks = {r.doc_id: r[column] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    return [(marks[r.doc_id], r) for r in got.collect() if r.doc_id in marks]


def test_cotraining_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where("doc_id % 3 <> 0")
    got = [x for x in _accuracy(spark, cotraining.scores(docs, cotraining.train(docs, learn, ["source", "lang"])), "quality") if x[1].doc_id % 3 == 0]
    assert np.mean([y == r.predicted for y, r in got]) > 0.9  # some 270 labels to learn from
    assert all(0 <= r.score <= 1 for _, r in got)


def test_cotraining_views_teach_each_other():
    r = np.random.default_rng(3)
    views, labels = [], []
    for i in range(600):
        y = i % 2
        views.append((np.unique(np.append(r.integers(100, 999, 5), [y])).astype(np.int32), np.array([50 + y], np.int32)))
        labels.append(y if i < 40 else None)
    model = cotraining.cotrain(views, labels)
    s = model.scores(*map(list, zip(*views)))[0]
    assert np.mean([(p >= 0.5) == (i % 2) for i, p in enumerate(s)]) > 0.98


def test_toxicity_held_out(spark):
    got = _accuracy(spark, queries.op5_ftrl_toxicity(spark, LARGE), "toxic", LARGE)
    for _, r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
    out = [(y, r) for y, r in got if r.held_out]
    assert np.mean([r.predicted for y, r in out if not y]) < 0.01
    assert np.mean([r.predicted for y, r in out if y]) > 0.7


def test_toxicity_never_sees_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    a = toxicity.train(docs, labels)
    b = toxicity.train(docs, labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert (a == b).all() and (a != 0).any()


def test_ftrl_is_sparse():
    r = np.random.default_rng(0)
    rows = [np.unique(np.append(r.integers(10, 1000, 30), [i % 2])) for i in range(2000)]
    w = Ftrl(10, alpha=1.0, l1=3.0).fit(rows, [float(i % 2) for i in range(2000)]).weights()
    assert (w[10:-1] != 0).mean() < 0.1 and all((margin(x, w) > 0) == (i % 2) for i, x in enumerate(rows))


def test_token_records_and_random_reads(spark, texts):
    folder, manifest = token_records.write_records(spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3))
    coder, at = word_tokens.word_ids(word_tokens.vocabulary_path()).library, 0
    want = {d: np.array([*coder.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    got = {r.doc_id: r for r in token_records.read_records(folder, manifest).collect()}
    for d in sorted(texts):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(want[d]), zlib.crc32(want[d].tobytes()))
        at += len(want[d])
    fs, base = pafs.FileSystem.from_uri(folder)
    for r in manifest.collect():
        width, ids, offsets, _ = token_records.read_index(fs.open_input_file(f"{base}/{r.path}.idx").read())
        with fs.open_input_file(f"{base}/{r.path}.rec") as f:
            for i in reversed(range(len(ids))):
                assert (np.frombuffer(token_records.read_frame(f, int(offsets[i])), f"<u{width}") == want[ids[i]]).all()


def test_quality_counts_by_hand(spark, texts):
    for r in quality_rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet")).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(g)
        rep = {i + j for i, x in enumerate(g) if c[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))


def test_quality_keeps_clean_text(spark):
    kept = {r.doc_id: r for r in queries.op8_quality_rules(spark, MID).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    assert all(kept[d].kept or kept[d].base_failed for d, y in marks.items() if y)
    assert not any(kept[d].kept for d, y in marks.items() if not y)


def _brute(texts, width, percent):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, texts, width, percent):
    got = near_dup.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet"), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _brute(texts, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Blocks smaller than a group, and chains whose ends differ."""
    r = random.Random(8)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    docs = {}
    for i in range(140):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(150)] = f"n{r.randrange(9999)}"
        docs[i] = " ".join(w)
    chain = list(base)
    for i in range(200, 230):
        chain[(i * 5) % 150] = f"c{i}"
        docs[i] = " ".join(chain)
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 16)
    got = near_dup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 3, 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == _brute(docs, 3, 85)


def test_stars_leave_nothing_open(spark, monkeypatch):
    """A large group around one hub, sets that are near a member but not the hub, and small groups, with tiny blocks and stars."""
    r = random.Random(21)
    base = [f"w{r.randrange(700)}" for _ in range(200)]
    docs = {}
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([0, 2, 4, 6, 20, 40])):
            w[r.randrange(200)] = f"n{r.randrange(99999)}"
        docs[i] = " ".join(w)
    for i in range(200, 260):
        docs[i] = " ".join([f"g{i // 3}x{k}" for k in range(80 + i % 3)])
    for name, value in (("BLOCK_SETS", 12), ("STAR_SETS", 9), ("BLOCK_SHINGLES", 5000)):
        monkeypatch.setattr(near_dup, name, value)
    for width, percent in ((3, 85), (5, 80)):
        got = near_dup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5), width, percent).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == _brute(docs, width, percent)


def test_pipeline_against_plain_stages(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/t-{name}-{os.getpid()}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
    kept = {r.doc_id for r in quality_rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet")).where("kept").collect()}
    assert {r.doc_id for r in seen["quality"].collect()} == kept
    w = toxicity.train(seen["quality"], spark.read.parquet(f"{SMALL}/labels.parquet"))
    civil = {r.doc_id for r in seen["quality"].collect() if margin(toxicity.features([r.text])[0], w) < 0}
    assert {r.doc_id for r in seen["toxicity"].collect()} == civil
    brute = _brute({d: texts[d] for d in civil}, 5, 80)
    assert {r.doc_id for r in seen["near_dedup"].collect()} == {d for d, (_, c) in brute.items() if c == d}
    assert {r.doc_id for r in seen["packing"].collect()} == {r.doc_id for r in seen["pii"].collect()} == {r.doc_id for r in seen["near_dedup"].collect()}
    assert all(r.n_chars == len(r.text) for r in seen["pii"].collect())
    a = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, seen["packing"].collect()))


def test_ftrl_against_the_plain_update():
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(0, 200, 20)) for _ in range(300)]
    labels = [float(x[0] % 2) for x in rows]
    got = Ftrl(8, alpha=0.5, l1=0.3).fit(rows, labels)
    z, n, rng = np.zeros(257), np.zeros(257), np.random.default_rng(7)
    for _ in range(2):
        for i in rng.permutation(300):
            at = [*rows[i].tolist(), 256]
            l1 = [0.3] * (len(at) - 1) + [0.0]
            w = [0.0 if abs(z[k]) <= b else -(z[k] - np.sign(z[k]) * b) / ((1 + np.sqrt(n[k])) / 0.5 + 1) for k, b in zip(at, l1)]
            g = 1 / (1 + np.exp(-sum(w))) - labels[i]
            for k, v in zip(at, w):
                z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / 0.5 * v
                n[k] += g * g
    assert np.allclose(got.z, z) and np.allclose(got.n, n)
