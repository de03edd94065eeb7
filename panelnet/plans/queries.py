"""The queries of the panel engine, each with DuckDB SQL for the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelnet import sources
from panelnet.functions import scalars
from panelnet.operators import annual, cluster, graph, indices, labels, panel, report, scaling
from panelnet.config import Config
from panelnet.plans import pipeline
from panelnet.plans import testbed as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C6 = tb.ALL
C7 = [*tb.ALL, "total"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: tb.result(f(spark, d))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def sel(source: str, i: str = "", d: str = "", s: str = "", where: str = "") -> str:
    """SELECT of integer, rounded double and other columns."""
    cols = [f"CAST({c} AS BIGINT) AS {c}" for c in i.split()] + [f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in d.split()] + s.split()
    return f"SELECT {', '.join(cols)} FROM {source} {where}"


def _interp(c: str) -> str:
    b = "OVER (PARTITION BY node_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    a = "OVER (PARTITION BY node_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    tt = f"CASE WHEN {c} IS NOT NULL THEN t END"
    pv, pt, nv, nt = f"last_value({c} IGNORE NULLS) {b}", f"last_value({tt} IGNORE NULLS) {b}", f"first_value({c} IGNORE NULLS) {a}", f"first_value({tt} IGNORE NULLS) {a}"
    return f"coalesce({c}, {pv} + ({nv} - {pv}) * (t - {pt}) / nullif({nt} - {pt}, 0), {pv}, {nv}) AS {c}"


PANEL = f"""WITH cells AS (SELECT l_suppkey AS node_id, strftime(l_shipdate, '%Y-%m') AS month, p_type, sum(l_extendedprice) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE strftime(l_shipdate, '%Y-%m') BETWEEN '{tb.FIRST}' AND '{tb.LAST}' GROUP BY ALL),
long AS (SELECT node_id, month, p_type AS category, value FROM cells WHERE p_type <> 'STANDARD'
  UNION ALL SELECT node_id, month, 'total', sum(value) FROM cells GROUP BY ALL),
pivoted AS (SELECT node_id, month, {', '.join(f"avg(value) FILTER (category = '{k}') AS {v}" for k, v in tb.CATEGORIES.items())} FROM long GROUP BY ALL),
wide AS (SELECT *, CASE WHEN total IS NOT NULL THEN greatest(0, total - ({' + '.join(f'coalesce({c}, 0)' for c in tb.NAMED)})) END AS c6 FROM pivoted),
months AS (SELECT strftime(d, '%Y-%m') AS month, (row_number() OVER (ORDER BY d) - 1)::INT AS t FROM (SELECT unnest(generate_series(DATE '{tb.FIRST}-01', DATE '{tb.LAST}-01', INTERVAL 1 MONTH)) AS d)),
dense AS (SELECT i.node_id, m.month, m.t, {', '.join(C7)}, w.node_id IS NOT NULL AS observed FROM (SELECT DISTINCT node_id FROM wide) i CROSS JOIN months m LEFT JOIN wide w ON w.node_id = i.node_id AND w.month = m.month),
kept AS (SELECT * FROM dense QUALIFY count(total) OVER (PARTITION BY node_id) >= {tb.LEAST_MONTHS}),
full_ AS (SELECT node_id, month, t, observed, {', '.join(_interp(c) for c in C7)} FROM kept),
smooth AS (SELECT node_id, month, t, {', '.join(f'avg({c}) OVER (PARTITION BY node_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS {c}' for c in C7)} FROM full_),
lab AS (SELECT node_id, t, (total > q[1])::INT + (total > q[2])::INT + (total > q[3])::INT AS label FROM smooth JOIN (SELECT t, quantile_cont(total, [0.25, 0.5, 0.75]) AS q FROM smooth GROUP BY t) USING (t)),
step AS (SELECT * FROM (SELECT node_id, t, label AS a, lead(label) OVER (PARTITION BY node_id ORDER BY t) AS b FROM lab) WHERE b IS NOT NULL),
yr AS (SELECT l_suppkey AS node_id, year(l_shipdate) AS year, l_returnflag || l_linestatus AS sector, l_quantity FROM lineitem),
yearly AS (SELECT node_id, year, sector, sum(l_quantity) AS value FROM yr GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT node_id, year, '101', sum(l_quantity) FROM yr GROUP BY ALL),
versions AS (SELECT s_suppkey AS territory_id, s_name AS name, s_suppkey * 10 AS code, 1990 AS year_from, 1997 AS year_to FROM supplier UNION ALL SELECT s_suppkey, s_name, s_suppkey * 10 + 1, 1998, 2099 FROM supplier),
facts AS (SELECT year, value, unnest([node_id * 10, node_id * 10 + 1]) AS code FROM yearly WHERE sector = '101'),
sect AS (SELECT node_id, year, coalesce(sum(value) FILTER (sector = 'AF'), 0) AS s1, coalesce(sum(value) FILTER (sector = 'NF'), 0) AS s2, coalesce(sum(value) FILTER (sector IN ('NO', 'RF')), 0) AS s3 FROM yearly WHERE sector IN ('AF', 'NF', 'NO', 'RF') GROUP BY ALL),
regs AS (SELECT s_suppkey AS node_id, n_regionkey::BIGINT AS region, (n_nationkey % 2)::BIGINT AS kind, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey),
dist AS (SELECT a.node_id AS src, b.node_id AS dst, round(abs(a.balance - b.balance), 6) AS d FROM regs a JOIN regs b ON a.node_id <> b.node_id WHERE round(abs(a.balance - b.balance), 6) < 3000),
pts AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS x, label FROM embeddings),
pd AS (SELECT a.node_id AS src, b.node_id AS dst, a.label AS la, b.label AS lb, round(list_distance(a.x, b.x), 9) AS v, list_cosine_similarity(a.x, b.x) AS cs FROM pts a JOIN pts b ON a.node_id <> b.node_id),
top AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY v, dst) AS rank FROM pd QUALIFY rank <= 5),
sig AS (SELECT src AS node_id, v + 1e-12 AS s FROM top WHERE rank = 3),
near AS (SELECT src, dst, greatest(exp(-v * v / (a.s * b.s)), 1e-6) AS w FROM top JOIN sig a ON a.node_id = src JOIN sig b ON b.node_id = dst),
g AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM near UNION ALL SELECT dst, src, w FROM near) GROUP BY ALL),
gl AS (SELECT src, dst, w, a.label AS a, b.label AS b FROM g JOIN pts a ON a.node_id = src JOIN pts b ON b.node_id = dst),
blk AS (SELECT a, b, sum(w) AS w FROM gl GROUP BY ALL),
per AS (SELECT label, n, coalesce(deg, 0) AS deg, coalesce(inn, 0) AS inn, coalesce(deg, 0) - coalesce(inn, 0) AS cut FROM (SELECT label, count(*) AS n FROM pts GROUP BY label) LEFT JOIN (SELECT a AS label, sum(w) AS deg, sum(w) FILTER (a = b) AS inn FROM blk GROUP BY a) USING (label))
"""


def P(final: str) -> str:  # noqa: N802
    return PANEL + final


# ---- panel ----
query("panel_pivot_mean", P(sel("pivoted", "node_id", "c1 c2 c3 c4 c5 total", "month")))(lambda s, d: panel.pivot_mean(tb.consumption(s, d), tb.CATEGORIES))
query("panel_residual_other", P(sel("wide", "node_id", " ".join(C7), "month")))(tb.wide)
query("panel_densify", P(sel("dense", "node_id t", " ".join(C7), "month observed")))(tb.dense)
query("panel_min_observed", P("SELECT node_id, count(total)::BIGINT AS n FROM kept GROUP BY node_id"))(lambda s, d: panel.observed_enough(tb.dense(s, d), tb.LEAST_MONTHS).groupBy("node_id").agg(F.count("total").alias("n")))
query("panel_interpolate", P(sel("full_", "node_id t", " ".join(C7), "month observed")))(tb.full)
query("smooth_centered", P(sel("smooth", "node_id t", " ".join(C7))))(lambda s, d: tb.smoothed(s, d).select("node_id", "t", *C7))
query("relative_level", P("SELECT node_id, t::BIGINT AS t, round(v - median(v) OVER (PARTITION BY t), 6) + 0.0 AS level FROM (SELECT *, CASE WHEN total > 0 THEN ln(total) END AS v FROM smooth)"))(lambda s, d: panel.relative_level(tb.smoothed(s, d)).select("node_id", "t", "level"))
query("relative_series", P("SELECT node_id, t::BIGINT AS t, " + ", ".join(f"round(ln({c} + 1) - median(ln({c} + 1)) OVER (PARTITION BY t), 6) + 0.0 AS {c}" for c in C6) + " FROM full_"))(lambda s, d: panel.relative_series(tb.full(s, d), C6).select("node_id", "t", *C6))
_tot = " + ".join(f"coalesce({c}, 0)" for c in C6)
_sh = [f"{c} / nullif({_tot}, 0) AS {c}" for c in C6]
query("shares_clr", P(f", sh AS (SELECT node_id, t, {', '.join(_sh)} FROM smooth), e AS (SELECT node_id, t, {', '.join(f'ln(({c} + 0.005) / ({" + ".join(f"({x} + 0.005)" for x in C6)})) AS {c}' for c in C6)} FROM sh) SELECT node_id, t::BIGINT AS t, {', '.join(f'round({c} - ({" + ".join(C6)}) / 6, 6) + 0.0 AS clr_{c}' for c in C6)} FROM e"))(lambda s, d: panel.shares_clr(tb.smoothed(s, d), C6).select("node_id", "t", *["clr_" + c for c in C6]))
query("seasonality", P(", v AS (SELECT node_id, month[1:4] AS y, month[6:7]::INT AS m, CASE WHEN total > 0 THEN ln(total) END AS v FROM full_), dm AS (SELECT node_id, y, m, v - avg(v) OVER (PARTITION BY node_id, y) AS v FROM v), yy AS (SELECT node_id, y, stddev_pop(v) AS a, avg(v) FILTER (m IN (6, 7, 8)) AS s FROM dm GROUP BY ALL) SELECT node_id, round(avg(a), 6) + 0.0 AS amplitude, round(avg(s), 6) + 0.0 AS summer FROM yy GROUP BY node_id"))(lambda s, d: panel.seasonality(tb.full(s, d)))
query("month_range", "SELECT strftime(d, '%Y-%m') AS month, (row_number() OVER (ORDER BY d) - 1)::BIGINT AS t FROM (SELECT unnest(generate_series(DATE '1999-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS d)")(lambda s, d: panel.month_table(s.range(1), tb.FIRST, tb.LAST))

# ---- dictionary and yearly ----
query("latest_version", P("SELECT territory_id, code, year_to::BIGINT AS year_to FROM versions QUALIFY row_number() OVER (PARTITION BY territory_id ORDER BY year_to DESC, year_from DESC) = 1"))(lambda s, d: sources.latest_version(tb.versions(s, d)).select("territory_id", "code", "year_to"))
query("interval_join", P("SELECT f.code, f.year, round(f.value, 6) + 0.0 AS value, territory_id FROM facts f JOIN versions v ON f.code = v.code AND f.year BETWEEN year_from AND year_to"))(lambda s, d: sources.interval_join(tb.facts(s, d), tb.versions(s, d)).select("code", "year", "value", "territory_id"))
query("interval_join_dedup", P("SELECT territory_id, year, round(min(value), 6) + 0.0 AS value FROM facts f JOIN versions v ON f.code = v.code AND f.year BETWEEN year_from AND year_to GROUP BY ALL"))(lambda s, d: sources.first_of(sources.interval_join(tb.facts(s, d), tb.versions(s, d)), ["territory_id", "year"], ["value", "code"]).select("territory_id", "year", "value"))
query("sector_map_pivot", P(sel("sect", "node_id year", "s1 s2 s3")))(lambda s, d: annual.sector_pivot(tb.yearly(s, d), tb.SECTORS))
query("nearest_year_asof", P(", r AS (SELECT * FROM sect WHERE year IN (1995, 1998, 2001) OR node_id % 3 = 0), y AS (SELECT unnest(range(1995, 2002)) AS target), j AS (SELECT node_id, target, r.year AS source_year, s1, s2, row_number() OVER (PARTITION BY node_id, target ORDER BY abs(target - r.year), r.year) AS n FROM r, y WHERE abs(target - r.year) <= 5) SELECT node_id, target AS year, source_year, round(s1, 6) + 0.0 AS s1, round(s2, 6) + 0.0 AS s2 FROM j WHERE n = 1"))(lambda s, d: annual.nearest_year(annual.sector_pivot(tb.yearly(s, d), tb.SECTORS).where("year in (1995, 1998, 2001) or node_id % 3 = 0"), list(range(1995, 2002)), ["s1", "s2"]))
_wt = ", wt AS (SELECT node_id, year, sum(value) FILTER (sector = 'AF') AS s1, sum(value) FILTER (sector = 'NF') AS s2, sum(value) FILTER (sector = 'NO') AS s3, sum(value) FILTER (sector = '101') AS total FROM yearly GROUP BY ALL)"


def _known(s, d):
    return tb.yearly(s, d).groupBy("node_id", "year").pivot("sector", ["AF", "NF", "NO", "101"]).sum("value").withColumnsRenamed({"AF": "s1", "NF": "s2", "NO": "s3", "101": "total"})


query("hidden_residual", P(_wt + ", k AS (SELECT *, coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0) AS known, coalesce(s1, s2, s3) IS NOT NULL AS any_ FROM wt), h AS (SELECT *, greatest(0, total - known) AS hid FROM k) SELECT node_id, year, " + ", ".join(f"CASE WHEN any_ AND total IS NOT NULL THEN round({x} / nullif(known + hid, 0), 6) + 0.0 END AS {n}" for x, n in (("coalesce(s1, 0)", "share_s1"), ("coalesce(s2, 0)", "share_s2"), ("coalesce(s3, 0)", "share_s3"), ("hid", "share_hidden"))) + " FROM h"))(lambda s, d: annual.hidden_residual(_known(s, d), ["s1", "s2", "s3"]).select("node_id", "year", "share_s1", "share_s2", "share_s3", "share_hidden"))


def _rates(s, d):
    lines = tb.read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("node_id"), F.year("l_shipdate").alias("year"))
    return lines.agg(F.avg("l_extendedprice").alias("wage"), F.sum("l_quantity").alias("employees"), (F.count("*") * 25.0).alias("population"))


query("wage_emp_rates", "WITH r AS (SELECT l_suppkey AS node_id, year(l_shipdate) AS year, ln(avg(l_extendedprice)) AS w, least(sum(l_quantity) / (count(*) * 25.0), 1.5) AS e FROM lineitem GROUP BY ALL) SELECT node_id, year, round(w - median(w) OVER (PARTITION BY year), 6) + 0.0 AS wage_rel, round(e, 6) + 0.0 AS emp_rate FROM r")(lambda s, d: annual.rates(_rates(s, d)).select("node_id", "year", "wage_rel", "emp_rate"))
query("missing_share", P("SELECT node_id, round((" + " + ".join(f"avg(({c} IS NULL)::INT)" for c in C6) + ") / 6, 6) + 0.0 AS missing_share FROM dense GROUP BY node_id"))(lambda s, d: annual.missing_share(tb.dense(s, d), C6))


@query("knn_impute")
def _impute(s, d):
    k = _known(s, d)
    return annual.knn_impute(k.withColumn("s3", F.when(F.col("node_id") % 5 == 0, None).otherwise(F.col("s3"))), ["total", "s1"], ["s2", "s3"])


# ---- scaling ----
_F3 = ["c1", "c2", "total"]
_cut = ", ".join(f"least(greatest({c}, q_{c}[1]), q_{c}[2]) AS {c}" for c in _F3)
_q = ", ".join(f"quantile_cont({c}, [0.01, 0.99]) AS q_{c}" for c in _F3)
query("winsorize_standardize", P(f", wz AS (SELECT node_id, t, {_cut} FROM smooth, (SELECT {_q} FROM smooth)) SELECT node_id, t::BIGINT AS t, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}" for c in _F3) + " FROM wz"))(lambda s, d: scaling.standardise(scaling.winsorise(tb.smoothed(s, d), _F3), _F3).select("node_id", "t", *_F3))
query("block_weights", P("SELECT node_id, t::BIGINT AS t, round(c1 / sqrt(2), 6) + 0.0 AS c1, round(c2 / sqrt(2), 6) + 0.0 AS c2, round(total * 0.75, 6) + 0.0 AS total FROM full_"))(lambda s, d: scaling.block_weights(tb.full(s, d), {"a": (["c1", "c2"], 1.0), "b": (["total"], 0.75)}).select("node_id", "t", *_F3))
query("minmax_heatmap", P(", m AS (SELECT t, avg(c1) AS c1, avg(c2) AS c2 FROM full_ GROUP BY t) SELECT t::BIGINT AS t, round((c1 - min(c1) OVER ()) / (max(c1) OVER () - min(c1) OVER () + 1e-12), 6) + 0.0 AS c1, round(1 - (c2 - min(c2) OVER ()) / (max(c2) OVER () - min(c2) OVER () + 1e-12), 6) + 0.0 AS c2 FROM m"))(lambda s, d: scaling.minmax(tb.full(s, d).groupBy("t").agg(F.avg("c1").alias("c1"), F.avg("c2").alias("c2")), {"c1": True, "c2": False}))

# ---- graphs ----
query("knn_euclid", P("SELECT src, dst, round(v, 6) + 0.0 AS v, rank FROM top"))(lambda s, d: graph.pair_top(tb.points(s, d), graph.euclid, 5, False).select("src", "dst", "v", "rank"))
query("self_tuning_graph", P(sel("g", "src dst", "w")))(lambda s, d: tb.point_graph(s, d).select("src", "dst", "w"))
query("cosine_graph", P(", ct AS (SELECT src, dst, greatest(round(cs, 9), 1e-6) AS w FROM pd QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(cs, 9) DESC, dst) <= 5) SELECT src, dst, round(max(w), 6) + 0.0 AS w FROM (SELECT src, dst, w FROM ct UNION ALL SELECT dst, src, w FROM ct) GROUP BY ALL"))(lambda s, d: graph.knn_similarity(tb.points(s, d), graph.cosine, 5).select("src", "dst", "w"))
_rel = ", rs AS (SELECT node_id, t, " + ", ".join(f"ln({c} + 1) - median(ln({c} + 1)) OVER (PARTITION BY t) AS {c}" for c in ("c1", "total")) + " FROM full_), zs AS (SELECT node_id, t, " + ", ".join(f"({c} - avg({c}) OVER w) / (stddev_pop({c}) OVER w + 1e-9) AS {c}" for c in ("c1", "total")) + " FROM rs WINDOW w AS (PARTITION BY node_id)), ser AS (SELECT node_id, list_concat(list(c1 ORDER BY t), list(total ORDER BY t)) AS x FROM zs GROUP BY node_id)"
query("corr_graph", P(_rel + ", cp AS (SELECT a.node_id AS src, b.node_id AS dst, round(list_inner_product(a.x, b.x) / 48, 9) AS v FROM ser a JOIN ser b ON a.node_id <> b.node_id), ck AS (SELECT src, dst, greatest(v, 1e-6) AS w FROM cp QUALIFY row_number() OVER (PARTITION BY src ORDER BY v DESC, dst) <= 5) SELECT src, dst, round(max(w), 6) + 0.0 AS w FROM (SELECT src, dst, w FROM ck UNION ALL SELECT dst, src, w FROM ck) GROUP BY ALL"))(lambda s, d: graph.knn_similarity(tb.series(s, d), graph.mean_product, 5).select("src", "dst", "w"))
_lags = " UNION ALL ".join(
    f"SELECT a.node_id AS src, b.node_id AS dst, {lag} AS lag, (" + " + ".join(
        f"(avg(a.{c} * b.{c}) - avg(a.{c}) * avg(b.{c})) / ((stddev_pop(a.{c}) + 1e-9) * (stddev_pop(b.{c}) + 1e-9))" for c in ("c1", "total")) + f") / 2 AS r FROM zs a JOIN zs b ON a.node_id <> b.node_id AND b.t = a.t + ({lag}) GROUP BY ALL" for lag in range(-2, 3))
query("lagcorr_pairs", P(_rel + f", lg AS ({_lags}), bl AS (SELECT src, dst, lag, round(r, 6) AS v FROM lg QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY round(r, 9) DESC, lag) = 1), rk AS (SELECT * FROM bl QUALIFY row_number() OVER (PARTITION BY src ORDER BY v DESC, dst) <= 3) SELECT src, dst, v + 0.0 AS v, lag::BIGINT AS lag FROM rk"))(lambda s, d: graph.pair_top(tb.series(s, d), graph.lagged(2, 2), 3, True, decimals=6).select("src", "dst", "v", "lag"))
query("geo_graph", P(", gk AS (SELECT src, dst, greatest(exp(-d / 500.0), 1e-6) AS w FROM dist QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 4) SELECT src, dst, round(max(w), 6) + 0.0 AS w FROM (SELECT src, dst, w FROM gk UNION ALL SELECT dst, src, w FROM gk) GROUP BY ALL"))(lambda s, d: graph.geo(tb.near_distances(s, d, 4), 4, 500.0).select("src", "dst", "w"))


@query("dtw_pairs")
def _dtw(s, d):
    return graph.pair_top(tb.series(s, d), graph.dtw(2), 3, False).select("src", "dst", "v", "rank")


def _flow_graph(s, d):
    """An edge table over months: node pairs of one label in a month, by chained ids."""
    l = tb.month_labels(s, d)
    a = l.select("t", "label", F.col("node_id").alias("src"))
    b = l.select("t", "label", F.col("node_id").alias("dst"))
    near = a.join(b, ["t", "label"]).where("src <> dst and abs(src - dst) <= 2")
    return near.select("t", "src", "dst", (F.lit(1.0) / F.abs(F.col("src") - F.col("dst"))).alias("w"))


_fg = ", fg AS (SELECT a.t, a.node_id AS src, b.node_id AS dst, 1.0 / abs(a.node_id - b.node_id) AS w FROM lab a JOIN lab b ON a.t = b.t AND a.label = b.label AND a.node_id <> b.node_id AND abs(a.node_id - b.node_id) <= 2)"
query("graph_memory", P(_fg + ", mm AS (SELECT m.t, src, dst, sum(w * CASE WHEN f.t = 0 THEN pow(0.6, m.t - f.t) ELSE 0.4 * pow(0.6, m.t - f.t) END) AS w FROM fg f JOIN months m ON m.t >= f.t GROUP BY ALL) SELECT t::BIGINT AS t, src, dst, round(w, 6) + 0.0 AS w FROM mm"))(lambda s, d: graph.memory(_flow_graph(s, d), tb.MONTHS, 0.4).select("t", "src", "dst", "w"))
query("hybrid_graph", P(_fg + ", a AS (SELECT src, dst, 0.7 * w / (SELECT max(w) FROM fg WHERE t = 3) AS w FROM fg WHERE t = 3), b AS (SELECT src, dst, 0.3 * w / (SELECT max(w) FROM fg WHERE t = 9) AS w FROM fg WHERE t = 9) SELECT src, dst, round(sum(w), 6) + 0.0 AS w FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL"))(lambda s, d: graph.hybrid(_flow_graph(s, d).where("t = 3").withColumn("t", F.lit(0)), _flow_graph(s, d).where("t = 9").withColumn("t", F.lit(0)), 0.7).select("src", "dst", "w"))
query("corr_window_bounds", "SELECT t::BIGINT AS t, greatest(hi - 12, 0)::BIGINT AS lo, hi::BIGINT AS hi FROM (SELECT t, least(greatest(t + 1, greatest(0, t - 11) + 12), 24) AS hi FROM range(24) r(t))")(lambda s, d: graph.window_bounds(s.range(24).select(F.col("id").cast("int").alias("t")), 12, 24))
query("induced_subgraph", P(sel("g", "src dst", "w", "", "WHERE src % 3 <> 0 AND dst % 3 <> 0")))(lambda s, d: graph.induced(tb.point_graph(s, d), tb.points(s, d).where("node_id % 3 <> 0")).select("src", "dst", "w"))
query("local_transitivity", P(", dg AS (SELECT src AS node_id, count(*) AS degree FROM g GROUP BY src), cl AS (SELECT a.src AS node_id, count(*) AS closed FROM g a JOIN g b ON a.src = b.src AND a.dst < b.dst JOIN g c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src) SELECT node_id, degree, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(closed, 0) / (degree * (degree - 1)) ELSE 0 END, 6) + 0.0 AS transitivity FROM dg LEFT JOIN cl USING (node_id)"))(lambda s, d: graph.local_transitivity(tb.point_graph(s, d)).drop("t"))
query("neighbor_purity", P("SELECT src AS node_id, round(avg((a = b)::INT), 6) + 0.0 AS purity FROM gl GROUP BY src"))(lambda s, d: graph.purity(tb.point_graph(s, d), tb.points(s, d)))
query("connected_components", P(", reach(x, y) AS (SELECT node_id, node_id FROM pts UNION SELECT r.x, g.dst FROM reach r JOIN g ON g.src = r.y) SELECT x AS node_id, min(y) AS component FROM reach GROUP BY x").replace("WITH cells", "WITH RECURSIVE cells", 1))(lambda s, d: graph.components(tb.point_graph(s, d), tb.points(s, d)))
query("graph_stats")(lambda s, d: graph.graph_stats(tb.point_graph(s, d), tb.points(s, d).select("node_id", F.col("label").alias("region"), (F.col("label") % 2).alias("kind"))))
query("agc_filter", P(", aw AS (SELECT src, dst, w FROM g UNION ALL SELECT node_id, node_id, 1.0 FROM pts), dd AS (SELECT src AS n, sqrt(sum(w)) AS d FROM aw GROUP BY src), ss AS (SELECT src, dst, w / (a.d * b.d) AS s FROM aw JOIN dd a ON a.n = src JOIN dd b ON b.n = dst), x0b AS (SELECT node_id, i, x[i] AS v FROM (SELECT node_id, x, unnest(range(1, 5)) AS i FROM pts)), x1 AS (SELECT src AS node_id, i, sum(s * v) AS m FROM ss JOIN x0b ON dst = node_id GROUP BY ALL), y1 AS (SELECT x0b.node_id, i, v / 2 + m / 2 AS v FROM x0b JOIN x1 USING (node_id, i)), x2 AS (SELECT src AS node_id, i, sum(s * v) AS m FROM ss JOIN y1 ON dst = node_id GROUP BY ALL) SELECT node_id, (i - 1)::BIGINT AS i, round(v / 2 + m / 2, 6) + 0.0 AS v FROM y1 JOIN x2 USING (node_id, i)"))(lambda s, d: graph.low_pass(tb.points(s, d).withColumn("x", F.slice("x", 1, 4)), tb.point_graph(s, d), 2).select("node_id", F.posexplode("x").alias("i", "v")))
def _road_distances(s, d):
    once = tb.regions(s, d).groupBy("node_id").count().where("count > 1").isEmpty()  # else a pair has rows in more than one place
    return graph.symmetric_distances(tb.paired_distances(s, d).withColumn("d", F.col("d") + F.col("src") % 2), "pair_of" if once else None)


query("road_distances", P("SELECT src, dst, round(min(d), 6) + 0.0 AS d FROM (SELECT src, dst, d + src % 2 AS d FROM dist UNION ALL SELECT dst, src, d + src % 2 FROM dist) GROUP BY ALL"))(_road_distances)

# ---- indices ----
query("block_weight_matrix", P("SELECT a::BIGINT AS a, b::BIGINT AS b, round(w, 6) + 0.0 AS w FROM blk"))(lambda s, d: indices.block_weights(tb.point_graph(s, d), tb.points(s, d)))
query("avi_avu_mq_q", P(", m2 AS (SELECT sum(deg) AS m2 FROM per), o AS (SELECT avg(inn / greatest(inn + cut, 1e-12)) AS avi, avg(inn / (n * n)) AS dense, sum(inn / m2 - pow(deg / m2, 2)) AS q FROM per, m2), pr AS (SELECT x.n AS nx, y.n AS ny, coalesce(w, 0) AS w, x.cut + y.cut - coalesce(w, 0) AS j FROM per x JOIN per y ON x.label < y.label LEFT JOIN blk ON blk.a = x.label AND blk.b = y.label) SELECT round(any_value(avi), 6) + 0.0 AS avi, round(avg(CASE WHEN j > 0 THEN w / j ELSE 0 END), 6) + 0.0 AS avu, round(any_value(dense) - avg(w / (2 * nx * ny)), 6) + 0.0 AS mq, round(any_value(q), 6) + 0.0 AS q FROM pr, o"))(lambda s, d: indices.graph_indices(tb.point_graph(s, d), tb.points(s, d)))
_tidy = ", td AS (SELECT node_id, label, unnest(range(1, 65)) AS i, unnest(x) AS v FROM pts)"
query("calinski_harabasz", P(_tidy + ", pl AS (SELECT label, i, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM td GROUP BY ALL), gr AS (SELECT i, avg(v) AS g FROM td GROUP BY i), sm AS (SELECT sum(n * (m - g) * (m - g)) AS b, sum(n * s) AS w, count(DISTINCT label) AS k, sum(n) FILTER (i = 1) AS n FROM pl JOIN gr USING (i)) SELECT round((b / (k - 1)) / (w / (n - k)), 6) + 0.0 AS ch FROM sm"))(lambda s, d: indices.calinski_harabasz(tb.points(s, d), tb.points(s, d)))
query("silhouette", P(", dm AS (SELECT src, la, lb, avg(list_distance(a.x, b.x)) AS d FROM pd JOIN pts a ON a.node_id = src JOIN pts b ON b.node_id = dst GROUP BY ALL), nd AS (SELECT src, max(d) FILTER (la = lb) AS a, min(d) FILTER (la <> lb) AS b FROM dm GROUP BY src) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) + 0.0 AS sw FROM nd"))(lambda s, d: indices.silhouette(tb.points(s, d), tb.points(s, d)))
query("s_dbw", P(_tidy + ", sp AS (SELECT label, i, var_pop(v) AS s, avg(v) AS m FROM td GROUP BY ALL), pc AS (SELECT label, sqrt(sum(s * s)) AS s, list(m ORDER BY i) AS c FROM sp GROUP BY label), wh AS (SELECT sqrt(sum(s * s)) AS al FROM (SELECT i, var_pop(v) AS s FROM td GROUP BY i)), bs AS (SELECT avg(s) AS ms, sqrt(sum(s)) / count(*) AS sd, count(*) AS k FROM pc), pp AS (SELECT a.label AS a, b.label AS b, a.c AS ca, b.c AS cb, list_transform(list_zip(a.c, b.c), lambda z : (z[1] + z[2]) / 2) AS u FROM pc a JOIN pc b ON a.label < b.label), cn AS (SELECT a, b, sum((list_distance(x, u) <= sd)::INT) AS m, sum((list_distance(x, ca) <= sd)::INT) AS da, sum((list_distance(x, cb) <= sd)::INT) AS db FROM pp JOIN pts ON label IN (a, b), bs GROUP BY ALL) SELECT round(ms / al + 2 * (SELECT sum(CASE WHEN greatest(da, db) > 0 THEN m / greatest(da, db) ELSE 0 END) FROM cn) / (k * (k - 1)), 6) + 0.0 AS s_dbw FROM bs, wh"))(lambda s, d: indices.s_dbw(tb.points(s, d), tb.points(s, d)))
_ends = ", ends AS (SELECT arg_min(label, t) AS a, arg_max(label, t) AS b FROM lab GROUP BY node_id)"


def _ends_df(s, d):
    return tb.month_labels(s, d).groupBy("node_id").agg(F.min_by("label", "t").alias("a"), F.max_by("label", "t").alias("b"))


def _agree(src: str) -> str:
    return f", cc AS (SELECT a, b, count(*) AS n FROM {src} GROUP BY ALL), ra AS (SELECT a, sum(n) AS na FROM cc GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM cc GROUP BY b), tt AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS ij FROM cc), sa AS (SELECT sum(na * (na - 1) / 2) AS sa, -sum(na / tt.n * ln(na / tt.n)) AS ha FROM ra, tt), sb AS (SELECT sum(nb * (nb - 1) / 2) AS sb, -sum(nb / tt.n * ln(nb / tt.n)) AS hb FROM rb, tt), mi AS (SELECT sum(cc.n / tt.n * ln(cc.n * tt.n / (na * nb))) AS mi FROM cc JOIN ra USING (a) JOIN rb USING (b), tt)"


query("ari", P(_ends + _agree("ends") + " SELECT round((ij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) + 0.0 AS ari FROM tt, sa, sb"))(lambda s, d: indices.agreement(_ends_df(s, d)).select("ari"))
query("nmi", P(_ends + _agree("ends") + " SELECT round(mi / ((ha + hb) / 2), 6) + 0.0 AS nmi FROM mi, sa, sb"))(lambda s, d: indices.agreement(_ends_df(s, d)).select("nmi"))
query("contingency", P(_ends + " SELECT a::BIGINT AS a, b::BIGINT AS b, count(*) AS n FROM ends GROUP BY ALL"))(lambda s, d: indices.contingency(_ends_df(s, d)))
query("best_jaccard", P(_ends + _agree("ends") + " SELECT a::BIGINT AS a, round(max(n / (na + nb - n)), 6) + 0.0 AS jaccard FROM cc JOIN ra USING (a) JOIN rb USING (b) GROUP BY a"))(lambda s, d: indices.best_jaccard(_ends_df(s, d)))

# ---- labels over time ----
query("month_labels", P("SELECT node_id, t::BIGINT AS t, label::BIGINT AS label FROM lab"))(tb.month_labels)
query("transition_matrix", P("SELECT a::BIGINT AS a, b::BIGINT AS b, count(*) AS n FROM step GROUP BY ALL"))(lambda s, d: labels.transitions(tb.month_labels(s, d)))
query("temporal_metrics")(lambda s, d: labels.temporal_metrics(tb.month_labels(s, d)))
query("switch_rate", P("SELECT round(sum(m) / sum(n), 6) + 0.0 AS switch_rate, round(avg((m = 0)::INT), 6) + 0.0 AS never_switch_share FROM (SELECT node_id, sum((a <> b)::INT) AS m, count(*) AS n FROM step GROUP BY node_id)"))(lambda s, d: labels.temporal_metrics(tb.month_labels(s, d)).select("switch_rate", "never_switch_share"))
query("cluster_events", P(", ec AS (SELECT t, a, b, count(*) AS n FROM step GROUP BY ALL), ee AS (SELECT *, sum(n) OVER (PARTITION BY t, a) AS na, sum(n) OVER (PARTITION BY t, b) AS nb FROM ec), fa AS (SELECT t, a, list_sort(coalesce(list(b) FILTER (n / nb >= 0.3), [])) AS bs, sum((n / na >= 0.3)::INT) AS kept FROM ee GROUP BY ALL), fb AS (SELECT t, b, list_sort(coalesce(list(a) FILTER (n / na >= 0.3), [])) AS xs, sum((n / nb >= 0.3)::INT) AS kept FROM ee GROUP BY ALL) SELECT t::BIGINT AS t, 'dissolution' AS event, a::VARCHAR AS a, '' AS b FROM fa WHERE kept = 0 AND len(bs) < 2 UNION ALL SELECT t, 'split', a::VARCHAR, array_to_string(bs, ',') FROM fa WHERE len(bs) >= 2 UNION ALL SELECT t, 'merge', array_to_string(xs, ','), b::VARCHAR FROM fb WHERE len(xs) >= 2 UNION ALL SELECT t, 'birth', '', b::VARCHAR FROM fb WHERE kept = 0"))(lambda s, d: labels.cluster_events(tb.month_labels(s, d)).select("t", "event", F.array_join("a", ",").alias("a"), F.array_join("b", ",").alias("b")))
_cnt = ", cnt AS (SELECT node_id, label, count(*) AS n, min(t) AS t0 FROM lab GROUP BY ALL), mode_ AS (SELECT node_id, label AS modal FROM cnt QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY n DESC, label) = 1)"
query("modal_label", P(_cnt + " SELECT node_id, modal::BIGINT AS modal FROM mode_"))(lambda s, d: labels.modal(tb.month_labels(s, d)))
query("modal_label_first_seen", P(_cnt + " SELECT node_id, label::BIGINT AS modal FROM cnt QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY n DESC, t0) = 1"))(lambda s, d: labels.modal(tb.month_labels(s, d), True))
_sum = _cnt + ", summ AS (SELECT node_id, modal, (SELECT count(*) FROM cnt c WHERE c.node_id = m.node_id) AS n_labels, coalesce((SELECT sum((a <> b)::INT) FROM step s WHERE s.node_id = m.node_id), 0) AS switches, (SELECT avg((label = modal)::INT) FROM lab l WHERE l.node_id = m.node_id) AS confidence FROM mode_ m)"
query("node_summary", P(_sum + " SELECT node_id, modal::BIGINT AS modal, n_labels::BIGINT AS n_labels, switches::BIGINT AS switches, round(confidence, 6) + 0.0 AS confidence FROM summ"))(lambda s, d: labels.node_summary(tb.month_labels(s, d)))
query("switch_classes", P(_sum + " SELECT CASE WHEN switches <= 2 THEN switches::VARCHAR WHEN switches <= 4 THEN '3-4' ELSE '5+' END AS switch_class, count(*) AS n FROM summ GROUP BY ALL"))(lambda s, d: report.switch_classes(labels.node_summary(tb.month_labels(s, d))))
query("order_labels", P(", mm AS (SELECT label, row_number() OVER (ORDER BY avg(total) DESC, label) - 1 AS new FROM lab JOIN smooth USING (node_id, t) GROUP BY label) SELECT node_id, t::BIGINT AS t, new::BIGINT AS label FROM lab JOIN mm USING (label)"))(lambda s, d: labels.relabel_by(tb.month_labels(s, d), tb.smoothed(s, d), "total"))
_ms = ", ms AS (SELECT t::VARCHAR AS method, round(avg(c1), 2) AS x, round(stddev_pop(c2), 2) AS y FROM full_ GROUP BY t), rk AS (SELECT method, rank() OVER (ORDER BY x DESC) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM ms)"
query("rank_methods", P(_ms + " SELECT method, round((rx + ry) / 2, 6) + 0.0 AS rank FROM rk"))(lambda s, d: labels.average_rank(tb.full(s, d).groupBy(F.col("t").cast("string").alias("method")).agg(F.round(F.avg("c1"), 2).alias("x"), F.round(F.stddev_pop("c2"), 2).alias("y")), {"x": True, "y": False}))
query("quantile_classes", P("SELECT node_id, t::BIGINT AS t, ((c1 > q[1])::INT + (c1 > q[2])::INT + (c1 > q[3])::INT + (c1 > q[4])::INT)::BIGINT AS class FROM full_ JOIN (SELECT t, quantile_cont(c1, [0.2, 0.4, 0.6, 0.8]) AS q FROM full_ GROUP BY t) USING (t)"))(lambda s, d: labels.quantile_classes(tb.full(s, d), "c1", ["t"]).select("node_id", "t", "class"))
query("quarter_flows", P(", ql AS (SELECT node_id, t, label AS a, lead(label) OVER (PARTITION BY node_id ORDER BY t) AS b FROM lab WHERE t % 3 = 0 OR t = 23) SELECT t::BIGINT AS t, a::BIGINT AS a, b::BIGINT AS b, count(*) AS n FROM ql WHERE b IS NOT NULL GROUP BY ALL"))(lambda s, d: report.quarter_flows(tb.month_labels(s, d), tb.MONTHS))
query("flow_totals", P(", f AS (SELECT t, a, b, count(*) AS n FROM step WHERE a <> b GROUP BY ALL) SELECT t::BIGINT AS t, label::BIGINT AS label, sum(i)::BIGINT AS inflow, sum(o)::BIGINT AS outflow FROM (SELECT t, a AS label, 0 AS i, n AS o FROM f UNION ALL SELECT t, b, n, 0 FROM f) GROUP BY ALL"))(lambda s, d: report.flow_totals(labels.steps(tb.month_labels(s, d)).groupBy("t", "a", "b").agg(F.count("*").alias("n"))))
query("composition_share", P(", cs AS (SELECT t, label, count(*) / sum(count(*)) OVER (PARTITION BY t) AS share FROM lab GROUP BY t, label) SELECT t::BIGINT AS t, label::BIGINT AS label, round(share, 6) + 0.0 AS share, round(share - lag(share) OVER (PARTITION BY label ORDER BY t), 6) + 0.0 AS change FROM cs"))(lambda s, d: report.composition(tb.month_labels(s, d)))
query("labels_wide", P("SELECT node_id, " + ", ".join(f"max(label) FILTER (t = {i})::BIGINT AS m{i}" for i in range(24)) + " FROM lab GROUP BY node_id"))(lambda s, d: report.labels_wide(tb.month_labels(s, d), tb.MONTHS))


# ---- reports ----
def _with_labels(s, d):
    return tb.smoothed(s, d).join(tb.month_labels(s, d), ["node_id", "t"])


query("profiles_median", P("SELECT label::BIGINT AS label, " + ", ".join(f"round(median({c}), 6) + 0.0 AS {c}" for c in C7) + ", round(count(*) / 24, 6) + 0.0 AS n_mean FROM smooth JOIN lab USING (node_id, t) GROUP BY label"))(lambda s, d: report.profiles_median(_with_labels(s, d), C7, tb.MONTHS))
_pz = ", pz AS (SELECT label, " + ", ".join(f"avg(({c} - m_{c}) / s_{c}) AS {c}" for c in C7) + " FROM smooth JOIN lab USING (node_id, t), (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in C7) + " FROM smooth) GROUP BY label)"
query("profiles_z", P(_pz + " " + sel("pz", "label", " ".join(C7))))(lambda s, d: report.profiles_z(_with_labels(s, d), C7))
query("signature_features", P(_pz + ", u AS (SELECT label, feature, z FROM (UNPIVOT pz ON " + ", ".join(C7) + " INTO NAME feature VALUE z)) SELECT label::BIGINT AS label, feature, round(z, 6) + 0.0 AS z, row_number() OVER (PARTITION BY label ORDER BY round(abs(z), 6) DESC, feature) AS rank FROM u QUALIFY rank <= 5"))(lambda s, d: report.signature(report.profiles_z(_with_labels(s, d), C7), C7))
query("label_crosstab", P(_cnt + " SELECT modal::BIGINT AS modal, count(*) FILTER (kind = 0) AS \"0\", count(*) FILTER (kind = 1) AS \"1\" FROM mode_ JOIN regs USING (node_id) GROUP BY modal"))(lambda s, d: report.crosstab(labels.modal(tb.month_labels(s, d)).join(tb.regions(s, d), "node_id"), "modal", "kind", [0, 1]))
query("trajectories", P(_cnt + " SELECT modal::BIGINT AS modal, t::BIGINT AS t, " + ", ".join(f"round(median({c}), 6) + 0.0 AS {c}" for c in C7) + " FROM smooth JOIN mode_ USING (node_id) GROUP BY modal, t"))(lambda s, d: report.trajectories(tb.smoothed(s, d).join(labels.modal(tb.month_labels(s, d)), "node_id"), C7))
query("sigma_convergence", P("SELECT t::BIGINT AS t, " + ", ".join(f"round(stddev_samp({c}), 6) + 0.0 AS {c}" for c in C7) + " FROM smooth GROUP BY t"))(lambda s, d: report.sigma_convergence(tb.smoothed(s, d), C7))


def _label_centres(s, d):
    p = _with_labels(s, d).select("label", F.array("c1", "c2").alias("x"))
    return cluster.centres_of(p)


_nl = ", ce AS (SELECT label, avg(c1) AS x, avg(c2) AS y FROM smooth JOIN lab USING (node_id, t) GROUP BY label), nl AS (SELECT a.label, b.label AS near, row_number() OVER (PARTITION BY a.label ORDER BY round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9), b.label) AS rank FROM ce a JOIN ce b ON a.label <> b.label QUALIFY rank <= 1)"
query("near_labels", P(_nl + " SELECT label::BIGINT AS label, near::BIGINT AS near, rank FROM nl"))(lambda s, d: report.near_labels(_label_centres(s, d), 1))
query("transition_adjacency", P(_nl + ", mv AS (SELECT a, b, count(*) AS n FROM step WHERE a <> b GROUP BY ALL), bo AS (SELECT label AS a, near AS b FROM nl UNION SELECT near, label FROM nl) SELECT round(sum(CASE WHEN bo.a IS NOT NULL THEN n ELSE 0 END) / sum(n), 6) + 0.0 AS share_near, sum(n)::BIGINT AS n_moves FROM mv LEFT JOIN bo ON bo.a = mv.a AND bo.b = mv.b"))(lambda s, d: report.transition_adjacency(tb.month_labels(s, d), report.near_labels(_label_centres(s, d), 1)))
query("lead_lag_by_type")(lambda s, d: report.lead_lag(graph.pairs_over(tb.series(s, d), graph.lagged(2, 2), 0.2), tb.regions(s, d), 0.2))
query("twins", P(", t30 AS (SELECT src, dst, la, lb, row_number() OVER (PARTITION BY src ORDER BY v, dst) AS r FROM pd QUALIFY r <= 29) SELECT src AS node_id, dst AS twin, row_number() OVER (PARTITION BY src ORDER BY r) AS rank FROM t30 WHERE la <> lb QUALIFY rank <= 5"))(lambda s, d: report.twins(tb.points(s, d), tb.points(s, d).select("node_id", F.col("label").alias("region"))))
query("top_examples", P("SELECT region, node_id, round(balance, 6) + 0.0 AS balance, row_number() OVER (PARTITION BY region ORDER BY balance DESC, node_id) AS rank FROM regs QUALIFY rank <= 8"))(lambda s, d: report.top_examples(tb.regions(s, d).select("region", "node_id", "balance"), "region", "balance", 8))
query("growth", P(_cnt + ", gm AS (SELECT modal, t, avg(total) AS v FROM smooth JOIN mode_ USING (node_id) GROUP BY ALL) SELECT modal::BIGINT AS modal, round(arg_max(v, t) / arg_min(v, t) - 1, 6) + 0.0 AS growth FROM gm GROUP BY modal"))(lambda s, d: report.growth(tb.smoothed(s, d).join(labels.modal(tb.month_labels(s, d)), "node_id"), "modal", "total"))
query("same_label_edge_share", P("SELECT round(avg((a = b)::INT), 6) + 0.0 AS share FROM gl"))(lambda s, d: tb.point_graph(s, d).join(tb.points(s, d).select(F.col("node_id").alias("src"), F.col("label").alias("a")), "src").join(tb.points(s, d).select(F.col("node_id").alias("dst"), F.col("label").alias("b")), "dst").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("share")))

# ---- scalars ----
query("name_search", "SELECT c_name AS name FROM customer WHERE contains(lower(c_name), '00001') ORDER BY c_name LIMIT 10")(lambda s, d: sources.search_names(tb.read(s, d, "customer").select(F.col("c_name").alias("name")), "name", "00001"))
query("code_digits", "SELECT s_suppkey, substr(regexp_replace(s_name, '[^0-9]', '', 'g'), 1, 8) AS code, lpad(s_suppkey::VARCHAR, 8, '0') AS padded FROM supplier")(lambda s, d: tb.read(s, d, "supplier").select("s_suppkey", scalars.code_digits(F.col("s_name")).alias("code"), scalars.padded_code(F.col("s_suppkey")).alias("padded")))
query("locale_number", "SELECT s_suppkey, round(s_acctbal, 6) + 0.0 AS v FROM supplier")(lambda s, d: tb.read(s, d, "supplier").select("s_suppkey", scalars.local_number(F.concat(F.lit("<b> "), F.replace(F.col("s_acctbal").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(",")), F.lit("&nbsp;</b>"))).alias("v")))
query("html_titles", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, (len(string_split(lower(html), '<p>')) - 1)::BIGINT AS n_p FROM pages")(lambda s, d: tb.read(s, d, "pages").select("page_id", scalars.title_of(F.col("html")).alias("title"), F.regexp_count("html", F.lit("(?i)<p>")).alias("n_p")))
query("event_props", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")(lambda s, d: tb.read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
query("typed_value_decode", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'null' WHEN event_id % 3 = 1 THEN event_id::VARCHAR ELSE '\"' || event_type || '\"' END AS v FROM events")(lambda s, d: tb.read(s, d, "events").select("event_id", scalars.typed_leaf(F.when(F.col("event_id") % 3 == 0, F.lit("__null__")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("__number__"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("__string__"), F.base64(F.col("event_type").cast("binary"))))).alias("v")))
_seq = "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY l_orderkey"


def _seqs(s, d):
    return tb.read(s, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("a"))


query("delta_encode", f"SELECT l_orderkey, array_to_string(list_transform(a, lambda x, i : x - CASE WHEN i > 1 THEN a[i - 1] ELSE 0 END), ',') AS d FROM ({_seq})")(lambda s, d: _seqs(s, d).select("l_orderkey", F.array_join(scalars.delta_encode(F.col("a")).cast("array<string>"), ",").alias("d")))
query("delta_decode", f"SELECT l_orderkey, array_to_string(a, ',') AS d FROM ({_seq})")(lambda s, d: _seqs(s, d).select("l_orderkey", F.array_join(scalars.delta_decode(scalars.delta_encode(F.col("a"))).cast("array<string>"), ",").alias("d")))
query("content_stamp", "SELECT page_id, substr(sha1(html), 1, 8) AS stamp FROM pages")(lambda s, d: tb.read(s, d, "pages").select("page_id", scalars.content_stamp(F.col("html")).alias("stamp")))
query("nodes_document", "SELECT s_suppkey AS id, '{\"id\":' || s_suppkey || ',\"name\":\"' || s_name || '\"}' AS doc FROM supplier")(lambda s, d: tb.read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("doc")))
query("excluded_types", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING') OR c_mktsegment IS NULL")(lambda s, d: sources.without_types(tb.read(s, d, "customer"), "c_mktsegment", ["BUILDING"]).select("c_custkey"))

# ---- clustering ----
_p8 = lambda s, d: tb.points(s, d).select("node_id", "x")
_c3 = [[0.0] * 64, [0.1] * 64, [-0.1] * 64]
query("assign_centers", P("SELECT node_id, (CASE WHEN d0 <= least(d1, d2) THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END)::BIGINT AS label FROM (SELECT node_id, round(list_sum(list_transform(x, lambda v : v * v)), 9) AS d0, round(list_sum(list_transform(x, lambda v : (v - 0.1) * (v - 0.1))), 9) AS d1, round(list_sum(list_transform(x, lambda v : (v + 0.1) * (v + 0.1))), 9) AS d2 FROM pts)"))(lambda s, d: cluster.assign(_p8(s, d), _c3).select("node_id", "label"))
query("kmeans_fixed_init")(lambda s, d: cluster.lloyd(_p8(s, d), _c3, 5)[0].select("node_id", "label"))
query("kmeans")(lambda s, d: cluster.kmeans(_p8(s, d), 10, restarts=2))
query("agc")(lambda s, d: cluster.agc(_p8(s, d), tb.point_graph(s, d), 10))
query("ward")(lambda s, d: cluster.ward(tb.points(s, d), 10))
query("spectral")(lambda s, d: cluster.spectral(tb.point_graph(s, d), 10))
query("leiden")(lambda s, d: cluster.leiden(tb.point_graph(s, d), 10))


def _month_points(s, d):
    cols = ["c1", "c2", "total"]
    return scaling.vectors(scaling.standardise(tb.smoothed(s, d), cols), cols)


def _month_graphs(s, d):
    return graph.self_tuning(_month_points(s, d), 5, 3)


query("evolutionary_kmeans")(lambda s, d: cluster.evolutionary_kmeans(_month_points(s, d), 4, 0.5, tb.MONTHS))
query("evolutionary_spectral")(lambda s, d: cluster.evolutionary_spectral(_month_graphs(s, d), 4, 0.7, tb.MONTHS))
query("temporal_leiden")(lambda s, d: cluster.temporal_leiden(_month_graphs(s, d), 1.0, 0.5))
query("match_labels")(lambda s, d: labels.match_in_time(tb.month_labels(s, d).withColumn("label", (F.col("label") + F.col("t")) % 4)))
query("permutation_test")(lambda s, d: report.permutation_test(tb.point_graph(s, d), tb.points(s, d).select("node_id", "label"), 1000))
query("stability_subsample")(lambda s, d: indices.agreement(cluster.lloyd(report.subsample(_p8(s, d), 0.8, 1), _c3, 3)[0].select("node_id", F.col("label").alias("a")).join(cluster.lloyd(_p8(s, d), _c3, 3)[0].select("node_id", F.col("label").alias("b")), "node_id")))
query("layout_2d")(lambda s, d: cluster.layout_2d(_p8(s, d)))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Panel -> features -> graph of the last month: the whole chain up to the edge list."""
    s = panel.shares_clr(panel.relative_level(tb.smoothed(spark, d)), C6)
    cols = ["level", *["clr_" + c for c in C6]]
    s = scaling.block_weights(scaling.standardise(scaling.winsorise(s, cols), cols), {"level": (["level"], 1.0), "structure": (cols[1:], 1.0)})
    return tb.result(graph.self_tuning(scaling.vectors(s, cols).where(F.col("t") == tb.MONTHS - 1), 5, 3))


QUERIES["flagship_graph"] = flagship

# ---- runs ----
query("k_selection")(lambda s, d: pipeline.choose_k(s, d, Config()))
query("edge_rules")(lambda s, d: pipeline.compare_rules(s, d, Config()))
query("rules_agreement")(lambda s, d: pipeline.rules_agreement(s, d, Config()))
query("method_comparison")(lambda s, d: pipeline.compare_methods(s, d, Config()))
query("sensitivity")(lambda s, d: pipeline.sensitivity(s, d, Config()))
