"""Summaries of a labelling: profiles, trajectories, adjacency of transitions, lead and lag, twins, flows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelnet.operators import graph
from panelnet.operators.labels import steps
from panelnet.operators.settle import settled


def profiles_median(d: DataFrame, columns: list[str], months: int) -> DataFrame:
    """d(node_id, t, label, columns) -> medians by label, and the mean number of nodes a month."""
    return d.groupBy("label").agg(*[F.median(c).alias(c) for c in columns], (F.count("*") / months).alias("n_mean"))


def profiles_z(d: DataFrame, columns: list[str]) -> DataFrame:
    """Mean z-scores by label, against the mean and sample deviation of all rows."""
    base = d.agg(*[F.avg(c).alias("_m" + c) for c in columns], *[F.stddev_samp(c).alias("_s" + c) for c in columns])
    z = [F.avg(F.try_divide(F.col(c) - F.col("_m" + c), F.col("_s" + c))).alias(c) for c in columns]
    return d.join(F.broadcast(base)).groupBy("label").agg(*z)  # base is one row


def signature(z: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """(label, rank, feature, z): the n features of largest absolute z of each label."""
    tidy = z.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("z")) for c in columns])).alias("e")).select("label", "e.*")
    w = W.partitionBy("label").orderBy(F.desc(F.round(F.abs("z"), 6)), "feature")
    return tidy.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def trajectories(d: DataFrame, columns: list[str]) -> DataFrame:
    """d(node_id, t, modal, columns) -> medians by modal label and month."""
    return d.groupBy("modal", "t").agg(*[F.median(c).alias(c) for c in columns])


def sigma_convergence(d: DataFrame, columns: list[str]) -> DataFrame:
    """Sample deviations over nodes, by month."""
    return d.groupBy("t").agg(*[F.stddev_samp(c).alias(c) for c in columns])


def crosstab(d: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return d.groupBy(row).pivot(column, values).count().fillna(0)


def near_labels(centres: DataFrame, n: int = 2) -> DataFrame:
    """centres(label, c) -> (label, near, rank): the n nearest other labels. Centres are k rows."""
    from panelnet.operators.indices import square_distance

    o = centres.select(F.col("label").alias("near"), F.col("c").alias("o"))
    d = centres.join(F.broadcast(o), F.col("label") != F.col("near")).withColumn("d", F.round(square_distance(F.col("c"), F.col("o")), 9))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy("d", "near"))).where(F.col("rank") <= n).select("label", "near", "rank")


def transition_adjacency(labels: DataFrame, near: DataFrame) -> DataFrame:
    """One row: the share of label changes that go to a near label, or come from one."""
    moves = steps(labels).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = near.select(F.col("label").alias("a"), F.col("near").alias("b")).unionByName(near.select(F.col("near").alias("a"), F.col("label").alias("b"))).distinct().withColumn("hit", F.lit(1))
    return moves.join(both, ["a", "b"], "left").agg(F.try_divide(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)), F.sum("n")).alias("share_near"), F.sum("n").alias("n_moves"))


def lead_lag(pairs: DataFrame, kinds: DataFrame, least: float = 0.7) -> DataFrame:
    """pairs(src, dst, v, lag), kinds(node_id, kind) -> by kind how often its nodes lead and follow those of others."""
    d = pairs.where((F.col("src") < F.col("dst")) & (F.col("v") > least) & (F.col("lag") != 0))
    lead, follow = F.when(F.col("lag") > 0, F.col("src")).otherwise(F.col("dst")), F.when(F.col("lag") > 0, F.col("dst")).otherwise(F.col("src"))
    d = d.select(lead.alias("lead"), follow.alias("follow"))
    a, b = (kinds.select(F.col("node_id").alias(e), F.col("kind").alias("k" + e)) for e in ("lead", "follow"))
    d = d.join(a, "lead").join(b, "follow").where("klead <> kfollow")
    sides = d.select(F.col("klead").alias("kind"), F.lit(1).alias("l"), F.lit(0).alias("f")).unionByName(d.select(F.col("kfollow").alias("kind"), F.lit(0).alias("l"), F.lit(1).alias("f")))
    return sides.groupBy("kind").agg(F.sum("l").alias("leads"), F.sum("f").alias("follows")).withColumn("lead_share", F.col("leads") / (F.col("leads") + F.col("follows")))


def twins(points: DataFrame, regions: DataFrame, among: int = 30, keep: int = 5) -> DataFrame:
    """points(t, node_id, x), regions(node_id, region) -> (node_id, twin, rank): of the nearest `among` - 1 others the first `keep` of another region."""
    top = graph.pair_top(points, graph.euclid, among - 1, largest=False)
    a, b = (regions.select(F.col("node_id").alias(e), F.col("region").alias("r" + e)) for e in ("src", "dst"))
    far = top.join(a, "src").join(b, "dst").where("rsrc <> rdst")
    w = W.partitionBy("src").orderBy("rank")
    return far.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).select(F.col("src").alias("node_id"), F.col("dst").alias("twin"), F.col("n").alias("rank"))


def quarter_flows(labels: DataFrame, months: int) -> DataFrame:
    """(t, a, b, n): moves between every third month and the last."""
    q = labels.where((F.col("t") % 3 == 0) | (F.col("t") == months - 1))
    return steps(q).groupBy("t", "a", "b").agg(F.count("*").alias("n"))


def flow_totals(flows: DataFrame) -> DataFrame:
    """(t, label, inflow, outflow) from and to other labels."""
    out = flows.where("a <> b").select("t", F.col("a").alias("label"), F.lit(0).alias("i"), F.col("n").alias("o"))
    into = flows.where("a <> b").select("t", F.col("b").alias("label"), F.col("n").alias("i"), F.lit(0).alias("o"))
    return out.unionByName(into).groupBy("t", "label").agg(F.sum("i").alias("inflow"), F.sum("o").alias("outflow"))


def composition(labels: DataFrame) -> DataFrame:
    """(t, label, share) of nodes, and the change since the month before."""
    n = labels.groupBy("t", "label").agg(F.count("*").alias("n"))
    d = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("t")))
    return d.select("t", "label", "share", (F.col("share") - F.lag("share").over(W.partitionBy("label").orderBy("t"))).alias("change"))


def switch_classes(summary: DataFrame) -> DataFrame:
    """Nodes by number of switches: 0, 1, 2, 3-4, 5 and more."""
    c = F.when(F.col("switches") <= 2, F.col("switches").cast("string")).when(F.col("switches") <= 4, "3-4").otherwise("5+")
    return summary.groupBy(c.alias("switch_class")).agg(F.count("*").alias("n"))


def top_examples(d: DataFrame, by: str, value: str, n: int) -> DataFrame:
    w = W.partitionBy(by).orderBy(F.desc(value), "node_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def growth(d: DataFrame, by: str, column: str) -> DataFrame:
    """By group the relative change of a column's mean from the first month to the last."""
    m = d.groupBy(by, "t").agg(F.avg(column).alias("v"))
    return m.groupBy(by).agg((F.max_by("v", "t") / F.min_by("v", "t") - 1).alias("growth"))


def principal_axis(d: DataFrame) -> DataFrame:
    """d(node_id, label, px, py) -> (node_id, label, place): order along the longest axis of each label's points."""
    s = d.groupBy("label").agg(F.avg("px").alias("mx"), F.avg("py").alias("my"), (F.atan2(2 * F.covar_pop("px", "py"), F.var_pop("px") - F.var_pop("py")) / 2).alias("phi"))
    along = (F.col("px") - F.col("mx")) * F.cos("phi") + (F.col("py") - F.col("my")) * F.sin("phi")
    return d.join(s, "label").withColumn("place", F.row_number().over(W.partitionBy("label").orderBy(F.round(along, 9), "node_id"))).select("node_id", "label", "place")


def labels_wide(labels: DataFrame, months: int) -> DataFrame:
    """One column m0, m1, .. a month."""
    wide = labels.groupBy("node_id").pivot("t", list(range(months))).agg(F.first("label"))
    return wide.withColumnsRenamed({str(i): f"m{i}" for i in range(months)})


#: Rounds of a permutation; each adds a random function of one part of a number to the other part.
ROUNDS = 8


def permuted(i: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """Where numbers 0 .. n - 1 go under the permutation that a key draws; work and memory are those of i and of the root of n.

    A number is a place in a table of about sqrt(n) rows and columns that holds at least n; what falls outside goes on until it is inside.
    """
    rows = int(np.ceil(np.sqrt(n)))
    sides = rows, -(-n // rows)
    rng = np.random.default_rng(key)
    tables = [rng.integers(0, sides[r % 2], sides[1 - r % 2]) for r in range(ROUNDS)]
    out, left = np.array(i, np.int64), np.arange(len(i))
    while len(left):
        part = list(np.divmod(out[left], sides[1]))
        for r, table in enumerate(tables):
            moved = part[r % 2] + table[part[1 - r % 2]]
            part[r % 2] = np.where(moved < sides[r % 2], moved, moved - sides[r % 2])
        out[left] = part[0] * sides[1] + part[1]
        left = left[out[left] >= n]
    return out


def _numbered(nodes: DataFrame) -> DataFrame:
    """nodes(node_id, ..) with their numbers i from 0 by node_id, without one task for all of them."""
    low = (1 << 33) - 1
    part = settled(nodes.repartitionByRange("node_id").sortWithinPartitions("node_id").withColumn("_m", F.monotonically_increasing_id()))
    sizes = part.groupBy(F.shiftright("_m", 33).cast("int").alias("_p")).agg(F.count("*").alias("n")).collect()  # a row a task
    before, first = 0, []
    for r in sorted(sizes):
        first.append((r[0], before))
        before += r[1]
    start = F.element_at(F.create_map(*[F.lit(v) for row in first for v in row]), F.shiftright("_m", 33).cast("int")) if first else F.lit(0)
    return part.withColumn("i", (start + F.col("_m").bitwiseAND(F.lit(low))).cast("long")).drop("_m")


def permutation_test(edges: DataFrame, labels: DataFrame, n: int = 1000, seed: int = 1) -> DataFrame:
    """One row (observed, null_mean, z, p) of the share of edges within a label against n permutations of the labels.

    Nodes are numbered by id, labels by the nodes that have them; a permutation gives a node the label of the number that its own
    number goes to. That is worked out for the ends of an edge alone: no table of nodes and permutations is made.
    """
    nodes = _numbered(labels.select("node_id", F.col("label").cast("double").alias("label")))
    counts = nodes.groupBy("label").agg(F.count("*").alias("n")).collect()  # a row a label
    known_counts = sorted((r[0], r[1]) for r in counts if r[0] is not None and r[0] == r[0])
    total, bounds = sum(r[1] for r in counts), np.cumsum([c for _, c in known_counts])
    a, b = (nodes.select(F.col("node_id").alias(e), F.col("i").alias("i" + e), F.col("label").alias("l" + e)).hint("merge") for e in ("src", "dst"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = edges.select("src", "dst").join(a, "src").join(b, "dst").select("isrc", "idst", "lsrc", "ldst").repartition(parts)  # few bytes and long to work on

    def hits(batches):
        """Edges within a label, and edges with two labels, of the labels themselves (p = 0) and of every permutation."""
        same, known = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for batch in (b for b in batches if b.num_rows):
            i, j, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            same[0] += np.count_nonzero(x == y)
            known[0] += np.count_nonzero((x == x) & (y == y))
            ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            for p in range(1, n + 1):
                label = np.searchsorted(bounds, permuted(ids, total, (seed, p)), side="right")  # len(bounds): no label
                x, y = np.split(label[at], 2)
                some = (x < len(bounds)) & (y < len(bounds))
                same[p] += np.count_nonzero((x == y) & some)
                known[p] += np.count_nonzero(some)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(same), pa.array(known)], names=["p", "s", "n"])

    share = settled(ends.mapInArrow(hits, "p long, s long, n long").groupBy("p").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("s")))
    own = share.where("p = 0").select(F.col("s").alias("observed"))
    return share.where("p > 0").crossJoin(F.broadcast(own)).where("s is not null").groupBy("observed").agg(
        F.avg("s").alias("null_mean"), F.try_divide(F.first("observed") - F.avg("s"), F.nullif(F.stddev_pop("s"), F.lit(0.0))).alias("z"),
        ((F.sum((F.col("s") >= F.col("observed")).cast("int")) + 1) / (n + 1)).alias("p"),
    )


def subsample(nodes: DataFrame, share: float, seed: int) -> DataFrame:
    """round(share * n) nodes: those of the least hash of (seed, node_id), ties by id."""
    n = nodes.count()
    order = [F.xxhash64(F.lit(seed), "node_id"), F.col("node_id")]
    last = nodes.select(order[0].alias("h"), "node_id").orderBy("h", "node_id").limit(round(share * n))
    return nodes.join(last.select("node_id"), "node_id", "left_semi")
