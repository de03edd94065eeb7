"""Stand-ins from the star-schema tables: a monthly panel, yearly indicators, vectors with labels, distances.

Panel: nodes are suppliers, months 1999-01 .. 2000-12, categories part types, values extended prices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelnet.operators import graph, labels, panel
from panelnet.operators.settle import settled

FIRST, LAST, MONTHS, LEAST_MONTHS = "1999-01", "2000-12", 24, 18
CATEGORIES = {"PROMO": "c1", "LARGE": "c2", "SMALL": "c3", "ECONOMY": "c4", "MEDIUM": "c5", "total": "total"}
NAMED, ALL = ["c1", "c2", "c3", "c4", "c5"], ["c1", "c2", "c3", "c4", "c5", "c6"]
SECTORS = {"AF": "s1", "NF": "s2", "NO": "s3", "RF": "s3"}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(c: Column) -> Column:
    """round(c, 6) of a double, which goes by way of decimals only where the seventh digit is near a half: a quotient of two whole
    numbers is the same double."""
    m = c * F.lit(1e6)
    plain = (F.abs(m - F.rint(m)) < 0.4) & (F.abs(m) < F.lit(float(1 << 52)))
    return F.when(plain, F.rint(m) / F.lit(1e6)).otherwise(F.round(c, 6))


def result(df: DataFrame) -> DataFrame:
    """Doubles rounded to six decimals without negative zeros, integers as 64-bit: what two engines agree on."""
    out = []
    for n, t in df.dtypes:
        c = F.col(n)
        out.append(((rounded(c) if t == "double" else F.round(c, 6)) + F.lit(0.0)).alias(n) if t in ("double", "float") else c.cast("long").alias(n) if t in ("int", "smallint", "tinyint") else c)
    return df.select(out)


def consumption(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, month, category, value): five named categories and the total over all six."""
    parts = read(spark, d, "part").select("p_partkey", "p_type")
    lines = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("node_id"), "l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice")
    cells = lines.where(F.col("month").between(FIRST, LAST)).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    cells = cells.groupBy("node_id", "month", "p_type").agg(F.sum("l_extendedprice").alias("value")).repartition("node_id")  # which serves all later groups
    named = F.when(F.col("p_type").isin([c for c in CATEGORIES if c != "total"]), F.array("p_type", F.lit("total"))).otherwise(F.array(F.lit("total")))
    return cells.select("node_id", "month", F.explode(named).alias("category"), "value").groupBy("node_id", "month", "category").agg(F.sum("value").alias("value"))


def wide(spark: SparkSession, d: str) -> DataFrame:
    """The panel as observed, settled: what follows reads it more than once, and lines only once."""
    return settled(panel.residual(panel.pivot_mean(consumption(spark, d), CATEGORIES), NAMED, out="c6"))


def dense(spark: SparkSession, d: str) -> DataFrame:
    return panel.densify(wide(spark, d), FIRST, LAST)


def full(spark: SparkSession, d: str) -> DataFrame:
    """The panel without gaps: nodes observed long enough, interpolated."""
    return panel.interpolate(panel.observed_enough(dense(spark, d), LEAST_MONTHS), [*ALL, "total"])


def smoothed(spark: SparkSession, d: str) -> DataFrame:
    return panel.smooth(full(spark, d), [*ALL, "total"])


def month_labels(spark: SparkSession, d: str) -> DataFrame:
    """labels(node_id, t, label): quantile classes 0..3 of the smoothed total within the month."""
    s = smoothed(spark, d)
    return labels.quantile_classes(s, "total", ["t"], (0.25, 0.5, 0.75)).select("node_id", "t", F.col("class").alias("label"))


def yearly(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, year, sector, value): quantities by return flag and line status; sector 101 is the total; small cells are withheld."""
    lines = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("node_id"), F.year("l_shipdate").alias("year"), F.concat("l_returnflag", "l_linestatus").alias("sector"), "l_quantity")
    cells = lines.groupBy("node_id", "year", "sector").agg(F.sum("l_quantity").alias("value"), F.count("*").alias("n"))
    total = lines.groupBy("node_id", "year").agg(F.sum("l_quantity").alias("value")).withColumn("sector", F.lit("101"))
    return cells.where("n > 1").drop("n").unionByName(total)


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Two validity ranges for each supplier: a code holds up to 1997 and from 1998 on."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("territory_id"), F.col("s_name").alias("name"))
    old = s.select("territory_id", "name", (F.col("territory_id") * 10).alias("code"), F.lit(1990).alias("year_from"), F.lit(1997).alias("year_to"))
    return old.unionByName(s.select("territory_id", "name", (F.col("territory_id") * 10 + 1).alias("code"), F.lit(1998).alias("year_from"), F.lit(2099).alias("year_to")))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """(code, year, value) under both codes of every supplier, so that only one of them is valid in a year."""
    y = yearly(spark, d).where("sector = '101'").select("node_id", "year", "value")
    return y.select("year", "value", F.explode(F.array(F.col("node_id") * 10, F.col("node_id") * 10 + 1)).alias("code"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, t, x, label) from the embeddings."""
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("node_id"), F.lit(0).alias("t"), F.col("embedding").cast("array<double>").alias("x"), "label")


def point_graph(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    return graph.self_tuning(points(spark, d), k, 3)


def regions(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, region, kind, balance): a supplier's region, the parity of its nation, its balance."""
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("node_id"), F.col("n_regionkey").cast("long").alias("region"), (F.col("n_nationkey") % 2).cast("long").alias("kind"), F.col("s_acctbal").alias("balance"))


#: Nodes of a bin that are one side of a task's pairs.
BLOCK = 512


def distances(spark: SparkSession, d: str, cutoff: float = 3000.0, parts: int = 16) -> DataFrame:
    """(t, src, dst, d): differences of supplier balances below a cutoff, found bin by bin; a bin is a part of the cutoff, so that there
    are many tasks and few pairs beyond it."""
    return paired_distances(spark, d, cutoff, parts).drop("pair_of")


def paired_distances(spark: SparkSession, d: str, cutoff: float = 3000.0, parts: int = 16) -> DataFrame:
    """distances() with pair_of, a number of two blocks of a bin's nodes: both directions of a pair have the same and lie in the same task.

    A bin's nodes are dealt to blocks of about BLOCK by their ids, so that no two bins are more than a small part of a task, however
    many balances are alike.
    """
    s = settled(regions(spark, d).where("balance is not null").select("node_id", "balance", F.floor(F.col("balance") / (cutoff / parts)).alias("bin")))
    sizes = s.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    s = settled(s.join(sizes, "bin").select("node_id", "balance", "bin", F.pmod(F.xxhash64("node_id"), F.col("n")).cast("int").alias("block")))
    one = s.select("bin", "block").distinct()
    far = one.select(F.col("block").alias("to_block"), F.col("bin").alias("to_bin"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts + 1)), lambda i: F.col("bin") - i)).alias("bin"))  # one more for rounding
    pairs = one.join(far, "bin").where("bin < to_bin or block <= to_block")
    pairs = settled(pairs.withColumn("pair_of", F.monotonically_increasing_id()))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // 4))
    left = pairs.join(s, ["bin", "block"]).select("pair_of", F.col("node_id").alias("a"), F.col("balance").alias("x"), ((F.col("bin") == F.col("to_bin")) & (F.col("block") == F.col("to_block"))).alias("same"))
    right = pairs.select("pair_of", F.col("to_bin").alias("bin"), F.col("to_block").alias("block")).join(s, ["bin", "block"]).select("pair_of", F.col("node_id").alias("b"), F.col("balance").alias("y"))
    near = left.repartition(tasks, "pair_of").join(right.repartition(tasks, "pair_of").hint("shuffle_hash"), "pair_of")
    gap = F.abs(F.col("x") - F.col("y"))
    below = (gap < cutoff - 1e-3) | ((gap < cutoff + 1e-3) & (rounded(gap) < cutoff))
    near = near.where("if(same, a < b, a <> b)").where(below).select("pair_of", "a", "b", rounded(gap).alias("d"))
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return near.select("pair_of", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e"), "d").select(F.lit(0).alias("t"), "e.src", "e.dst", "d", "pair_of")


def near_distances(spark: SparkSession, d: str, k: int, cutoff: float = 3000.0) -> DataFrame:
    """The rows of distances() with each node's k least distances, ties by dst, without the others."""
    at = regions(spark, d).where("balance is not null").select(F.lit(0).alias("t"), "node_id", F.array(F.col("balance").cast("double")).alias("x"))
    near = graph.pair_top(at, graph.euclid, k, largest=False, decimals=6)
    return near.select("t", "src", "dst", F.col("v").alias("d")).where(F.col("d") < cutoff)


def series(spark: SparkSession, d: str) -> DataFrame:
    """(t, node_id, x) with the relative series of two categories one after the other, z-scored over time."""
    cols = ["c1", "total"]
    z = panel.zscore_in_time(panel.relative_series(full(spark, d), cols), cols)
    in_time = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("t", F.col(c).alias("v")))), lambda x: x["v"])
    lists = z.groupBy("node_id").agg(*[in_time(c).alias(c) for c in cols])
    return lists.select(F.lit(0).alias("t"), "node_id", F.concat(*cols).alias("x"))
