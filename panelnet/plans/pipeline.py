"""Whole runs: features, graphs by rule, choice of k, comparison of rules and methods, sensitivity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelnet.config import Config
from panelnet.operators import cluster, graph, indices, jobs, labels, panel, report, scaling
from panelnet.operators.settle import settled
from panelnet.plans import testbed as tb

RULES = ("attr", "cosine", "corr", "lagcorr", "dtw", "geo", "hybrid")
METHODS = jobs.METHODS
SEASON = ["amplitude", "summer"]
STRUCTURE = ["clr_" + c for c in tb.ALL]
COLUMNS = ["level", *STRUCTURE, *SEASON]


def standardised(spark: SparkSession, d: str, cfg: Config) -> DataFrame:
    """(node_id, t, COLUMNS): level, structure and seasonality, winsorised and standardised over the panel."""
    full = settled(panel.interpolate(panel.observed_enough(panel.densify(tb.wide(spark, d), *cfg.months), cfg.min_months_observed), [*tb.ALL, "total"]))
    s = panel.smooth(full, [*tb.ALL, "total"], cfg.smoothing_window)
    f = panel.shares_clr(panel.relative_level(s), tb.ALL, cfg.clr_pseudocount).join(panel.seasonality(full), "node_id")
    return scaling.standardise(scaling.winsorise(settled(f.select("node_id", "t", *COLUMNS)), COLUMNS), COLUMNS)


def weighted(f: DataFrame, cfg: Config) -> DataFrame:
    """(node_id, t, x) of standardised columns, block-weighted."""
    w = cfg.block_weights
    f = scaling.block_weights(f, {"level": (["level"], w["level"]), "structure": (STRUCTURE, w["structure"]), "seasonality": (SEASON, w["seasonality"])})
    return scaling.vectors(f, COLUMNS)


def features(spark: SparkSession, d: str, cfg: Config) -> DataFrame:
    return settled(weighted(standardised(spark, d, cfg), cfg))


def month_graph(spark: SparkSession, d: str, cfg: Config, x: DataFrame, rule: str, t: int, full: DataFrame | None = None, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """The similarity graph of one month by one rule; an unknown rule is an error.

    full is tb.full() and known has graphs of other rules for the same month, where a run has them already.
    """
    month = x.where(F.col("t") == t)
    if rule == "attr":
        return graph.self_tuning(month, cfg.knn, cfg.self_tuning_neighbor)
    if rule == "cosine":
        return graph.knn_similarity(month.withColumn("x", F.slice("x", 2, len(STRUCTURE))), graph.cosine, cfg.knn)
    if rule == "geo":
        return graph.geo(tb.near_distances(spark, d, cfg.knn).withColumn("t", F.lit(t)), cfg.knn, cfg.geo_scale)
    if rule == "hybrid":
        parts = {r: (known or {}).get(r) for r in ("attr", "corr")}
        return graph.hybrid(*[month_graph(spark, d, cfg, x, r, t, full) if g is None else g for r, g in parts.items()], cfg.hybrid_alpha)
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; known are {', '.join(RULES)}")
    lo, hi = graph.window_bounds(spark.range(1).select(F.lit(t).alias("t")), cfg.corr_window, tb.MONTHS).select("lo", "hi").first()
    cols = ["c1", "total"]
    full = tb.full(spark, d) if full is None else full
    rel = panel.relative_series(full, cols)
    if rule == "corr":
        rel = rel.where((F.col("t") >= lo) & (F.col("t") < hi))
    z = panel.zscore_in_time(rel, cols)
    in_time = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("t", F.col(c).alias("v")))), lambda p: p["v"])
    s = z.groupBy("node_id").agg(*[in_time(c).alias(c) for c in cols]).select(F.lit(t).alias("t"), "node_id", F.concat(*cols).alias("x"))
    if rule == "corr":
        return graph.knn_similarity(s, graph.mean_product, cfg.knn)
    if rule == "lagcorr":
        return graph.knn_similarity(s, graph.lagged(len(cols), cfg.max_lag), cfg.knn)
    return graph.self_tuning(s, cfg.knn, cfg.self_tuning_neighbor, graph.dtw(cfg.dtw_window))


def _grid(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of a run's jobs, from its parameters."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def month_jobs(x: DataFrame, edges: DataFrame, methods: tuple[str, ...], k: int) -> tuple[DataFrame, DataFrame]:
    """Points and edges of a job for each method and month, named "method:t"."""
    rows = _grid(x.sparkSession, [(m, k) for m in methods], "method string, k int")
    job = F.concat_ws(":", "method", "t").alias("job")
    return x.crossJoin(rows).select(job, "method", "k", "t", "node_id", "x"), edges.crossJoin(rows).select(job, "src", "dst", "w")


def _compact(labels_: DataFrame) -> DataFrame:
    """Settled in as few partitions as the rows need: labels of many jobs and methods come in hundreds, and are read dozens of times."""
    return settled(labels_.repartition("method", "t"))


def by_month(labels_: DataFrame) -> DataFrame:
    """(method, t, node_id, label) of jobs named "method:t"."""
    part = F.split("job", ":")
    return labels_.select(part[0].alias("method"), part[1].cast("int").alias("t"), "node_id", "label")


def static_labels(method: str, points: DataFrame, edges: DataFrame, k: int, cfg: Config) -> DataFrame:
    """(node_id, t, label) of months by one method; an unknown method is an error."""
    if method not in jobs.METHODS:
        raise ValueError(f"unknown method {method!r}; known are {', '.join(jobs.METHODS)}")
    p, e = month_jobs(points, edges, (method,), k)
    return by_month(jobs.labelled(p, e, cfg.seed, cfg.agc_power, cfg.least_size, cfg.starts)).select("node_id", "t", "label")


def score(points: DataFrame, edges: DataFrame, lab: DataFrame) -> DataFrame:
    """One row (sw, ch, s_dbw, avi, avu, mq, q), all null with fewer than two labels."""
    lab = settled(lab.select("node_id", "label"))
    parts = [indices.silhouette(points, lab), indices.calinski_harabasz(points, lab), indices.s_dbw(points, lab), indices.graph_indices(edges, lab)]
    row = reduce(lambda a, b: a.join(b), parts)  # each has one row
    several = lab.agg((F.count_distinct("label") > 1).alias("_ok"))
    return row.join(several, how="right").select(*[F.when(F.col("_ok"), F.col(c)).alias(c) for c in row.columns])


def _counted(grid: list[tuple]) -> list[tuple[str, list[int]]]:
    """(method, counts) of runs: spectral's counts share the eigenvectors of a graph, other methods have a run for each count."""
    spectral = [k for m, k in grid if m == "spectral"]
    return [(m, [k]) for m, k in grid if m != "spectral"] + ([("spectral", spectral)] if spectral else [])


def _subsampled(points: DataFrame, edges: DataFrame, base: DataFrame, grid: list[tuple], cfg: Config) -> DataFrame:
    """(method, k, stability, stability_sd): ARI of labels with those of subsamples, for jobs (method, k) of one month.

    points and edges are those of the month, base has (method, k, node_id, label).
    """
    spark = points.sparkSession
    tries = [(m, max(ks), ks, i, f"{m}:{'{}'}:{i}" if len(ks) > 1 else f"{m}:{ks[0]}:{i}") for m, ks in _counted(grid) for i in range(cfg.subsamples)]
    rows = _grid(spark, tries, "method string, k int, ks array<int>, i int, job string")
    some = settled(reduce(DataFrame.unionByName, [report.subsample(points, cfg.subsample_share, cfg.seed + i + 1).select("node_id", "x", F.lit(i).alias("i")) for i in range(cfg.subsamples)]))
    lab = jobs.labelled(some.join(rows, "i"), edges.crossJoin(rows), cfg.seed, cfg.agc_power, cfg.least_size, cfg.starts)
    part = F.split("job", ":")
    lab = lab.select(part[0].alias("method"), part[1].cast("int").alias("k"), part[2].cast("int").alias("i"), "node_id", F.col("label").alias("a"))
    pairs = settled(lab.join(base.withColumnRenamed("label", "b"), ["method", "k", "node_id"]))
    ari = indices.agreement(pairs.select("method", "k", "i", "a", "b"), ["method", "k", "i"])
    return ari.groupBy("method", "k").agg(F.avg("ari").alias("stability"), F.stddev_pop("ari").alias("stability_sd"))


def choose_k(spark: SparkSession, d: str, cfg: Config, methods: tuple[str, ...] = ("kmeans", "agc", "spectral")) -> DataFrame:
    """(k, method, indices.., stability, stability_sd) for the reference month, over cfg.k_range and all methods."""
    x = features(spark, d, cfg)
    points, edges = settled(x.where(F.col("t") == cfg.reference_month)), settled(month_graph(spark, d, cfg, x, "attr", cfg.reference_month))
    grid = [(m, k) for m in methods for k in range(cfg.k_range[0], cfg.k_range[1] + 1)]
    rows = _grid(spark, [(m, k, f"{m}:{k}") for m, k in grid], "method string, k int, job string")
    runs = _grid(spark, [(m, max(ks), ks, f"{m}:{'{}'}" if len(ks) > 1 else f"{m}:{ks[0]}") for m, ks in _counted(grid)], "method string, k int, ks array<int>, job string")
    p, e = points.crossJoin(rows), edges.crossJoin(rows)
    lab = settled(jobs.labelled(points.crossJoin(runs), edges.crossJoin(runs), cfg.seed, cfg.agc_power, cfg.least_size, cfg.starts))
    base = lab.join(rows, "job").select("method", "k", "node_id", "label")
    scores = jobs.scored(p, e, lab, jobs.WITHOUT_PAIRS).join(jobs.silhouettes(points, lab), "job", "left").select("job", *jobs.SCORES)
    return scores.join(rows, "job").drop("job").join(_subsampled(points, edges, base, grid, cfg), ["method", "k"])


def _rule_runs(spark: SparkSession, d: str, cfg: Config, rules: tuple[str, ...], methods: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(points, edges with their rule, jobs (rule, method, job), labels of all jobs) of the reference month."""
    x = features(spark, d, cfg)
    points = settled(x.where(F.col("t") == cfg.reference_month))
    full = settled(tb.full(spark, d).select("node_id", "t", "c1", "total")) if {"corr", "lagcorr", "dtw", "hybrid"} & set(rules) else None
    known: dict[str, DataFrame] = {}
    for rule in sorted(rules, key=lambda r: r == "hybrid"):  # made of two others
        known[rule] = settled(month_graph(spark, d, cfg, x, rule, cfg.reference_month, full, known).select("t", "src", "dst", "w"))
    edges = reduce(DataFrame.unionByName, [g.select(F.lit(rule).alias("rule"), "t", "src", "dst", "w") for rule, g in known.items()])
    rows = _grid(spark, [(r, m, cfg.k, f"{r}:{m}") for r in rules for m in methods], "rule string, method string, k int, job string")
    lab = settled(jobs.labelled(points.crossJoin(rows), edges.join(rows, "rule"), cfg.seed, cfg.agc_power, cfg.least_size, cfg.starts))
    return points, edges, rows, lab


def compare_rules(spark: SparkSession, d: str, cfg: Config, rules: tuple[str, ...] = RULES, methods: tuple[str, ...] = ("spectral", "leiden", "agc")) -> DataFrame:
    """(rule, method, edges, mean_degree, .., indices, indices of the graph part on the attribute graph as avi_attr ..)."""
    points, edges, rows, lab = _rule_runs(spark, d, cfg, rules, methods)
    nodes = settled(points.select("node_id").join(tb.regions(spark, d), "node_id"))
    stats = reduce(DataFrame.unionByName, [graph.graph_stats(edges.where(F.col("rule") == r), nodes).withColumn("rule", F.lit(r)) for r in rules])
    p = points.crossJoin(rows)
    own = jobs.scored(p, edges.join(rows, "rule"), lab)
    attr = month_graph(spark, d, cfg, points, "attr", cfg.reference_month) if "attr" not in rules else edges.where("rule = 'attr'")
    on_attr = jobs.scored(p, attr.select("src", "dst", "w").crossJoin(rows), lab, jobs.OF_GRAPH)
    on_attr = on_attr.select("job", *[F.col(c).alias(f"{c}_attr") for c in jobs.OF_GRAPH])
    return own.join(on_attr, "job").join(rows, "job").join(stats, "rule").drop("job", "k")


def rules_agreement(spark: SparkSession, d: str, cfg: Config, rules: tuple[str, ...] = RULES, method: str = "agc") -> DataFrame:
    """(rule_a, rule_b, ari): agreement of the partitions that one method finds on the graphs of two rules."""
    _, _, rows, lab = _rule_runs(spark, d, cfg, rules, (method,))
    lab = lab.join(rows, "job").select("rule", "node_id", "label")
    a, b = (lab.select(F.col("rule").alias(f"rule_{e}"), "node_id", F.col("label").alias(e)) for e in ("a", "b"))
    return indices.agreement(a.join(b, "node_id").select("rule_a", "rule_b", "a", "b"), ["rule_a", "rule_b"]).select("rule_a", "rule_b", "ari")


def compare_methods(spark: SparkSession, d: str, cfg: Config, months: int = tb.MONTHS, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(method, mean indices, temporal metrics, bootstrap_ari, rank) over the months, labels matched in time.

    Evolutionary methods have the bootstrap ARI of the static ones that they go on from; temporal Leiden has none.
    """
    x = settled(features(spark, d, cfg).where(F.col("t") < months))
    edges = settled(graph.self_tuning(x, cfg.knn, cfg.self_tuning_neighbor))
    lab = _compact(by_month(settled(jobs.labelled(*month_jobs(x, edges, methods, cfg.k), cfg.seed, cfg.agc_power, cfg.least_size, cfg.starts))))
    found = {m: labels.match_in_time(lab.where(F.col("method") == m).select("node_id", "t", "label")) for m in methods}
    kept = settled(graph.memory(edges, months, cfg.evolution_alpha))
    for m in ("spectral", "agc"):
        found[f"{m}_evolutionary"] = labels.match_in_time(settled(static_labels(m, x, kept, cfg.k, cfg)))
    found["kmeans_evolutionary"] = cluster.evolutionary_kmeans(x, cfg.k, cfg.evolution_alpha, months, cfg.seed)
    found["temporal_leiden"] = cluster.temporal_leiden(edges, 1.0, cfg.leiden_interslice, cfg.seed)
    every = _compact(reduce(DataFrame.unionByName, [f.select(F.lit(m).alias("method"), F.col("t").cast("int").alias("t"), "node_id", F.col("label").cast("int").alias("label")) for m, f in found.items()]))
    p, e = month_jobs(x, edges, tuple(found), cfg.k)
    per = by_month_scores(jobs.scored(p, e, every.select(F.concat_ws(":", "method", "t").alias("job"), "node_id", "label")))
    mean = per.groupBy("method").agg(*[F.avg(c).alias(c) for c in jobs.SCORES])
    over = reduce(DataFrame.unionByName, [labels.temporal_metrics(every.where(F.col("method") == m)).withColumn("method", F.lit(m)) for m in found])
    t = min(cfg.reference_month, months - 1)
    base = lab.where(F.col("t") == t).select("method", F.lit(cfg.k).alias("k"), "node_id", "label")
    boot = _subsampled(x.where(F.col("t") == t), edges.where(F.col("t") == t), base, [(m, cfg.k) for m in methods], cfg).select(F.col("method").alias("of"), F.col("stability").alias("bootstrap_ari"))
    table = mean.join(over, "method").withColumn("of", F.regexp_replace("method", "_evolutionary$", "")).join(boot, "of", "left").drop("of")
    table = settled(table)
    better = {"sw": True, "ch": True, "s_dbw": False, "avi": True, "avu": False, "mq": True}
    return table.join(labels.average_rank(table, better), "method")


def by_month_scores(scores: DataFrame) -> DataFrame:
    part = F.split("job", ":")
    return scores.select(part[0].alias("method"), part[1].cast("int").alias("t"), *jobs.SCORES)


def _every_node(x: DataFrame, lab: DataFrame) -> DataFrame:
    """lab with the nodes of x that have no edge, as label 0: a month of a single node."""
    return x.select("node_id", "t").join(lab, ["node_id", "t"], "left").select("node_id", "t", F.coalesce("label", F.lit(0)).alias("label"))


def final_labels(spark: SparkSession, d: str, cfg: Config, months: int = tb.MONTHS, x: DataFrame | None = None) -> DataFrame:
    """The final model: evolutionary spectral clustering of attribute graphs."""
    x = settled(features(spark, d, cfg)) if x is None else x
    x = x.where(F.col("t") < months)
    edges = graph.self_tuning(x, cfg.knn, cfg.self_tuning_neighbor)
    return labels.match_in_time(_every_node(x, cluster.memory_cuts(edges, cfg.k, cfg.evolution_alpha, months)))


def variants(cfg: Config) -> dict[str, Config]:
    """The final model's parameters, one changed at a time: block weights, neighbours, memory, seed."""
    out = {f"{b} x {f}": cfg.with_(block_weights={**cfg.block_weights, b: cfg.block_weights[b] * f}) for b in cfg.block_weights for f in (0.0, 0.5, 2.0)}
    out |= {f"knn {k}": cfg.with_(knn=k) for k in (cfg.knn - 2, cfg.knn + 2)} | {f"self-tuning {r}": cfg.with_(self_tuning_neighbor=r) for r in (cfg.self_tuning_neighbor - 1, cfg.self_tuning_neighbor + 2)}
    return out | {f"alpha {a}": cfg.with_(evolution_alpha=a) for a in (0.5, 0.9)} | {f"k {k}": cfg.with_(k=k) for k in (cfg.k - 1, cfg.k + 1)}


def _final_runs(f: DataFrame, runs: list[Config], months: int) -> list[DataFrame]:
    """final_labels() of several configurations over the same standardised columns.

    What runs share is done once: one search of nearest others for each set of block weights, one graph for each pair of
    neighbours and rank, one plan of spectral jobs for each memory and count. A run's months are t + months * its number.
    """
    f = settled(f.where(F.col("t") < months))
    sets = [c for i, c in enumerate(runs) if c.block_weights not in [r.block_weights for r in runs[:i]]]
    set_of = [next(j for j, s in enumerate(sets) if s.block_weights == c.block_weights) for c in runs]
    x = settled(reduce(DataFrame.unionByName, [weighted(f, c).withColumn("t", (F.col("t") + j * months).cast("int")) for j, c in enumerate(sets)]))
    top = graph.pair_top(x, graph.euclid, max(max(c.knn, c.self_tuning_neighbor) for c in runs), largest=False)
    graphs: dict[tuple[int, int], DataFrame] = {}
    for key in {(c.knn, c.self_tuning_neighbor): None for c in runs}:
        used = sorted({set_of[i] for i, c in enumerate(runs) if (c.knn, c.self_tuning_neighbor) == key})
        graphs[key] = settled(graph.tuned(top.where(F.floor(F.col("t") / months).isin(used)), *key))
    cuts = []
    for alpha, k in {(c.evolution_alpha, c.k): None for c in runs}:
        parts = []
        for key, g in graphs.items():
            here = [i for i, c in enumerate(runs) if (c.evolution_alpha, c.k, c.knn, c.self_tuning_neighbor) == (alpha, k, *key)]
            if here:
                to = F.create_map(*[v for j in sorted({set_of[i] for i in here}) for v in (F.lit(j), F.array(*[F.lit(i) for i in here if set_of[i] == j]))])
                at = F.explode(F.element_at(to, F.floor(F.col("t") / months).cast("int"))).alias("run")  # null, so no row, for sets of other runs
                parts.append(g.select("*", at).select((F.col("t") % months + F.col("run") * months).cast("int").alias("t"), "src", "dst", "w"))
        cuts.append(cluster.memory_cuts(reduce(DataFrame.unionByName, parts), k, alpha, months))
    lab = settled(reduce(DataFrame.unionByName, cuts))
    own = lambda i: lab.where(F.floor(F.col("t") / months) == i).withColumn("t", (F.col("t") % months).cast("int"))
    return [labels.match_in_time(_every_node(f, own(i))) for i in range(len(runs))]


def sensitivity(spark: SparkSession, d: str, cfg: Config, months: int = tb.MONTHS) -> DataFrame:
    """(variant, ari_panel, ari_ref_month, switch_rate, least_jaccard) of the final model under changed parameters."""
    t, names = min(cfg.reference_month, months - 1), variants(cfg)
    base, *each = _final_runs(standardised(spark, d, cfg), [cfg, *names.values()], months)
    base = settled(base)
    lab = settled(reduce(DataFrame.unionByName, [r.select(F.lit(name).alias("variant"), "node_id", "t", "label") for name, r in zip(names, each)]))
    pairs = settled(lab.withColumnRenamed("label", "a").join(base.withColumnRenamed("label", "b"), ["node_id", "t"]))
    panel_ = indices.agreement(pairs.select("variant", "a", "b"), ["variant"]).select("variant", F.col("ari").alias("ari_panel"))
    month = indices.agreement(pairs.where(F.col("t") == t).select("variant", "a", "b"), ["variant"]).select("variant", F.col("ari").alias("ari_ref_month"))
    after = F.lead("label").over(Window.partitionBy("variant", "node_id").orderBy("t"))
    moved = lab.withColumn("next", after).where("next is not null").groupBy("variant").agg(F.avg((F.col("label") != F.col("next")).cast("double")).alias("switch_rate"))
    n = pairs.groupBy("variant", "a", "b").agg(F.count("*").alias("n"))
    of_a, of_b = n.groupBy("variant", "a").agg(F.sum("n").alias("na")), n.groupBy("variant", "b").agg(F.sum("n").alias("nb"))
    best = n.join(of_a, ["variant", "a"]).join(of_b, ["variant", "b"]).groupBy("variant", "b").agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j"))
    return panel_.join(month, "variant").join(moved, "variant").join(best.groupBy("variant").agg(F.min("j").alias("least_jaccard")), "variant")
