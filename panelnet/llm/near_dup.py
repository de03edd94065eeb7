"""Near-duplicate documents: MinHash with banding, exact confirmation, components by star steps.

1. Each document gets its set of distinct word shingles (64-bit hashes), a key of the whole set, and one
   hash for each band of `rows` minima. Documents with equal sets collapse to one set with a number of its own.
2. Sets that share a band hash are candidates. Each set is held against a hub first, the least member that most of
   its buckets have in common: full sets, one row shuffled for a set. Confirmed links collapse large groups.
3. Buckets that still hold sets of several components are left. Those that hang together ("blobs") hold every
   candidate pair; their full sets meet in one task, or block by block where a blob is large, but for blocks of one
   component. No pair is emitted, only links of a spanning forest of the pairs that reach the threshold.
4. The components of the confirmed links are the result.

With 32 bands of 6 rows a pair at Jaccard 0.85 is missed with probability 3e-7, at 0.9 with 1e-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from panelnet.llm.common import as_text, batch_of, discard, release, rows_of, slices, stored
from panelnet.llm.words import ASCII_SPACE, hash_words, mix64, separators
from panelnet.operators.components import connected_components
from panelnet.operators.settle import even_join

BANDS, ROWS = 32, 6
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
#: Members of a hub that one task holds against it.
STAR_SETS = 256
_SEP = separators(ASCII_SPACE)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; a shorter text is one shingle, no words give none.

    bytes.lower() changes A-Z only, and words end at ASCII white space only.
    """
    _, _, _, h, first = hash_words([t.encode().lower() for t in texts], _SEP)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        w = min(width, b - a)
        x = np.zeros(b - a - w + 1 if w else 0, np.uint64)
        for i in range(w):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[a + i : a + i + len(x)])
        out.append(np.unique(x + np.uint64(w)))
    return out


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minima(shingles: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        v = x[None, i : i + 1024] * mult[:, None]
        v += add[:, None]
        np.minimum(low, v.min(axis=1), out=low)
    return low


def _signatures(width: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = _multipliers(bands * rows)
        weights = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        for part in rows_of(batches, "doc_id", "text"):
            ids, sizes, keys, hashes = [], [], [], []
            for (doc_id, _), s in zip(part, shingle_sets([t for _, t in part], width)):
                ids.append(doc_id)
                sizes.append(len(s))
                if len(s):
                    keys.append(_key(s))
                    b = mix64((minima(s, mult, add) * weights).reshape(bands, rows).sum(axis=1, dtype=np.uint64))
                    hashes.append(b.view(np.int64))
                else:
                    keys.append(None)
                    hashes.append(None)
            yield batch_of(schema, [ids, sizes, keys, hashes])

    return run, "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(width: int):
    schema = pa.schema([("set_key", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, "doc_id", "text"):
            sets = [s for s in shingle_sets([t for _, t in part], width) if len(s)]
            yield batch_of(schema, [[_key(s) for s in sets], [s.tobytes() for s in sets]])

    return run, "set_key binary, shingles binary"


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """The matrix of intersection sizes, by products of 0/1 blocks over shingles that two sets share."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    values, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], place[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.int64)
    for at in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(col, [at, at + columns])
        m = np.zeros((n, columns), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least position that a chain of pairs with 100 * |A and B| >= percent * |A or B| reaches."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    both = overlaps(sets)
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(near, True)
    label = np.arange(len(sets))
    while True:
        low = np.where(near, label[None, :], len(sets)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _confirm(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(set(zip(group.column("rep").to_pylist(), group.column("shingles").to_pylist())))
        ids = np.array([r for r, _ in rows], dtype=np.int64)
        label = linked([np.frombuffer(s, np.uint64) for _, s in rows], percent)
        far = ids[label] != ids
        return pa.table([pa.array(ids[far]), pa.array(ids[label[far]])], schema=schema)

    return run, "a long, b long"


def _star(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by hub, the hub's own set before those of its members: each is held against it, one after another."""
        at, middle = None, np.empty(0, np.uint64)
        for batch in slices(batches, "shingles"):
            links = []
            for hub, rep, raw in zip(*(batch.column(c).to_pylist() for c in ("hub", "rep", "shingles"))):
                own = np.frombuffer(raw, np.uint64)
                if rep == hub:
                    at, middle = hub, own
                    continue
                if at != hub:
                    raise ValueError("a hub's set is missing")
                place = np.searchsorted(middle, own)
                both = int((middle[np.minimum(place, len(middle) - 1)] == own).sum())
                if 100 * both >= percent * (len(own) + len(middle) - both):
                    links.append((rep, hub))
            yield batch_of(schema, list(zip(*links)) or [[], []])
        release()

    return run, "a long, b long"


def _star_links(hits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each set against one hub, the least member that most of its buckets have in common: a row shuffled for a row."""
    most = hits.where("rep <> low").groupBy("rep", "low").agg(F.count("*").alias("n"))
    star = stored(most.groupBy("rep").agg(F.max_by("low", F.struct("n", -F.col("low"))).alias("hub")), "stars")
    load = star.groupBy("hub").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / STAR_SETS).cast("int"))
    load = stored(load, "hubs")
    dealt = even_join(star, load, "hub", star.count()).select("rep", "hub", F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("salt"))
    dealt = dealt.unionByName(load.select(F.col("hub").alias("rep"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    rows = sets.join(dealt, "rep").select("hub", "salt", "rep", "shingles")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("rep") != F.col("hub"), "rep")
    run, schema = _star(percent)
    links = stored(rows.mapInArrow(run, schema), "links")
    discard(star, load)
    return links


def _block_links(hits: DataFrame, sizes: DataFrame, sets: DataFrame, links: DataFrame, percent: int, total: int) -> DataFrame:
    """What the stars leave open: buckets that hold sets of more than one component, blocks against blocks.

    Components of more than half a block have blocks of their own, which are not held against one another.
    """
    found = stored(connected_components(links).withColumnRenamed("node", "rep"), "found")
    tagged = hits.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    tagged = stored(tagged, "tagged")
    mixed = tagged.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y").select("bucket", "n")
    open_ = stored(even_join(tagged, mixed, "bucket", total).select("rep", "low", "component").distinct(), "open")
    blobs = connected_components(open_.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnsRenamed({"node": "rep", "component": "blob"})
    members = stored(blobs.join(open_.select("rep", "component").distinct(), "rep").join(sizes, "rep"), "members")
    per = members.groupBy("blob", "component").agg(F.count("*").alias("n"), F.sum("size").alias("s")).withColumn("own", F.when(F.col("n") > BLOCK_SETS / 2, F.col("component")).otherwise(F.lit(-1)))
    room = F.greatest(F.ceil(F.sum("n") / BLOCK_SETS), F.ceil(F.sum("s") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    dealt = per.groupBy("blob", "own").agg(room.alias("blocks"))
    before = Window.partitionBy("blob").orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int")).withColumn("all", F.sum("blocks").over(Window.partitionBy("blob")).cast("int"))
    placed = members.join(per.select("blob", "component", "own"), ["blob", "component"]).join(dealt, ["blob", "own"])
    placed = placed.withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    apart = lambda k: (k != F.col("block")) & ((F.col("own") < 0) | (k < F.col("first")) | (k >= F.col("first") + F.col("blocks")))
    other = F.explode(F.when(F.col("all") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("all") - 1), apart)))
    pairs = placed.select("rep", "blob", "block", other.alias("other")).select("rep", "blob", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    run, schema = _confirm(percent)
    out = stored(sets.join(pairs, "rep").groupBy("blob", "i", "j").applyInArrow(run, schema), "links")
    discard(found, tagged, open_, members)
    return out


def _groups(docs: DataFrame, width: int, percent: int, bands: int = BANDS, rows: int = ROWS, by_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a row for a row: doc_id, n_shingles, set_key; a row for a set: set_key, least doc_id, group). by_id: sets with the same least doc_id are linked."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text"))
    run, schema = _signatures(width, bands, rows)
    signed = stored(docs.mapInArrow(run, schema), "signatures")
    reps = (
        signed.where("set_key is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    )
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "sets")
    total = bands * reps.count()
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    lowest = buckets.groupBy("bucket").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1")
    hits = stored(even_join(buckets, lowest, "bucket", total), "hits")
    wanted = reps.join(hits.select("rep").distinct(), "rep").select("rep", "set_key", "least")
    run, schema = _sets(width)
    named = docs.where("doc_id is not null").join(wanted.where("least is not null").select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    nameless = docs.where("doc_id is null").mapInArrow(run, schema).dropDuplicates(["set_key"])
    sets = named.mapInArrow(run, schema).join(wanted.where("least is not null").select("rep", "set_key"), "set_key")
    sets = sets.unionByName(nameless.join(wanted.where("least is null").select("rep", "set_key"), "set_key"))
    sets = stored(sets.select("rep", "shingles").dropDuplicates(["rep"]), "shingles")
    near = _star_links(hits, sets, percent)
    far = _block_links(hits, reps.select("rep", "size"), sets, near, percent, total)
    links = near.unionByName(far)
    if by_id:
        again = reps.groupBy("least").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("least is not null and n > 1").drop("n")
        links = links.unionByName(reps.join(again, "least").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    found = connected_components(links)
    named = stored(reps.join(found, reps.rep == found.node, "left").select("set_key", "least", F.coalesce("component", "rep").alias("group")), "groups")
    discard(reps, hits, sets, near, far)
    return signed, named


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), one row for each row of docs.

    A null or blank text has an empty set and links with nothing: it is its own component. Sets are compared by a
    number of their own, so rows without a doc_id take part; a component is named by its least doc_id, null if no
    row of it has one. Sets with the same least doc_id are one component. Rows that repeat a doc_id are kept or not
    together, as are rows without one; one_of_each() tells such rows apart. Other columns of docs are ignored,
    whatever their names; an empty table gives an empty result. Texts are read whole, however long.
    """
    signed, groups = _groups(docs, width, percent, bands, rows, by_id=True)
    named = groups.join(groups.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("set_key", "component_id")
    out = signed.join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    result = stored(out, "near")
    discard(signed, groups)
    return result


def _keyed(names: list[str], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keys = [_key(s) if len(s) else None for s in shingle_sets([t or "" for t in batch.column("text").to_pylist()], width)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(keys, pa.binary())], names=[*names, "_set_key"])
        release()

    return run


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, that of the least doc_id (nulls last); all columns stay.

    Rows with an empty set stay. Rows that share a doc_id or have none are told apart by their sets: different texts
    under one doc_id are different documents, and of rows with the same doc_id and set the one of the least text stays.
    """
    every, groups = _groups(docs, width, percent)
    signed = every.where("set_key is not null")
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "set_key")).alias("best"))
    named = groups.join(best, "group").select("set_key", "least", (F.col("set_key") == F.col("best.set_key")).alias("wins"))
    named = stored(named, "winners")
    gone = signed.join(named, "set_key").where(~(F.col("wins") & F.col("doc_id").eqNullSafe(F.col("least")))).select("doc_id")
    shared = stored(signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id")), "shared")
    away = stored(gone.select(F.col("doc_id").alias("_gone")).unionByName(shared.select(F.col("_id").alias("_gone"))).distinct(), "away")
    discard(every, groups)
    alone = docs.join(away, docs["doc_id"].cast("long").eqNullSafe(away["_gone"]), "left_anti")
    if shared.isEmpty():
        return alone
    rest = docs.join(shared, docs["doc_id"].cast("long").eqNullSafe(shared["_id"]), "left_semi")
    rest = rest.mapInArrow(_keyed(docs.columns, width), StructType([*docs.schema.fields, StructField("_set_key", BinaryType())]))
    blank = rest.where("_set_key is null").select(docs.columns)
    wins = named.where("wins").select(F.col("set_key").alias("_set_key"), F.col("least").alias("_least"))
    rest = rest.join(wins, "_set_key").where(F.col("doc_id").cast("long").eqNullSafe(F.col("_least")))
    one = rest.groupBy("_set_key").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("_row")).select("_row.*")
    return alone.unionByName(blank).unionByName(one)
