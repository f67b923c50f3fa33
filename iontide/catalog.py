"""Every query of the engine's own operators over the test tables, with its SQL.

The tables aren't ion lists; each operator runs on a structural analogue: prices are spectra,
flags are species, the first three components of embeddings are positions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iontide.functions import crystal, geometry, ions, physics
from iontide.operators import bins, calibration, composition, deconvolution, mesh, ordered, ranging, reconstruction, spatial, spectrum, volume
from iontide.streaming import spectra

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    from iontide import catalog_more  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ions: ionIdx, mc (thousands of the price), ion, chargeState."""
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ionIdx")
    return table(spark, sf_dir, "lineitem").select(key, (F.col("l_extendedprice") / 1000).alias("mc"), F.col("l_returnflag").alias("ion"), F.col("l_linestatus").alias("chargeState"))


PRICES = "(SELECT l_orderkey * 8 + l_linenumber AS \"ionIdx\", l_extendedprice / 1000 AS mc, l_returnflag AS ion, l_linestatus AS \"chargeState\" FROM lineitem)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ions with a unique ionIdx: mc is the value."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ionIdx"), F.col("value").alias("mc"))


HITS = '(SELECT event_id AS "ionIdx", value AS mc FROM events)'


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i, name: (F.element_at("embedding", i).cast("double") * 10).alias(name)
    return table(spark, sf_dir, "embeddings").select("vec_id", part(1, "x"), part(2, "y"), part(3, "z"), "label")


POINTS = "(SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z, label FROM embeddings)"

RANGES = [(0, "low", 1.0, 8.5), (1, "middle", 12.0, 30.25), (2, "high", 41.5, 55.0)]
LAPPED = [*RANGES, (3, "edge", 28.0, 44.0)]


def ranges(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "rangeIdx int, rangeName string, mcbegin double, mcend double")


def range_sql(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{n}', {a}, {b})" for i, n, a, b in rows) + ") AS r(\"rangeIdx\", \"rangeName\", mcbegin, mcend)"


# Spectra and ranges


@query(f"SELECT floor(mc / 0.5)::BIGINT AS bin, (floor(mc / 0.5) + 0.5) * 0.5 AS mc, count(*) AS counts FROM {PRICES} GROUP BY floor(mc / 0.5)")
def spectrum_histogram(spark, sf_dir):
    return bins.histogram(prices(spark, sf_dir), "mc", 0.5)


@query(f"""
WITH n AS (SELECT coalesce(r."rangeName", 'unranged') AS species, count(*) AS count FROM {PRICES} p LEFT JOIN {range_sql(RANGES)} ON p.mc BETWEEN r.mcbegin AND r.mcend GROUP BY 1),
c AS (SELECT species, count, CASE WHEN species = 'unranged' THEN 0.0 ELSE count::DOUBLE / sum(CASE WHEN species <> 'unranged' THEN count END) OVER () END AS concentration FROM n)
SELECT species, count, round(concentration, 9) AS concentration, round(concentration * (1 - concentration) / count * (1 - 0.37), 15) AS variance FROM c""")
def ranged_composition(spark, sf_dir):
    ranged = ranging.allocate_disjoint(prices(spark, sf_dir), ranges(spark, RANGES))
    out = composition.composition(ranged, "rangeName", 37, ["unranged"])
    return out.select("species", "count", F.round("concentration", 9).alias("concentration"), F.round("variance", 15).alias("variance"))


@query(f"""
WITH b AS (SELECT p."ionIdx", max(r."rangeIdx") AS i FROM {HITS} p LEFT JOIN {range_sql(LAPPED)} ON p.mc BETWEEN r.mcbegin AND r.mcend GROUP BY 1)
SELECT coalesce(i, -1) AS range_idx, count(*) AS n FROM b GROUP BY 1""")
def last_range_wins(spark, sf_dir):
    found = ranging.allocate(hits(spark, sf_dir), ranges(spark, LAPPED))
    return found.groupBy(F.coalesce("rangeIdx", F.lit(-1)).alias("range_idx")).agg(F.count(F.lit(1)).alias("n"))


@query(f'SELECT count(*) AS n, sum("ionIdx")::BIGINT AS keys FROM {HITS} p WHERE NOT EXISTS (SELECT 1 FROM {range_sql(LAPPED)} WHERE p.mc BETWEEN r.mcbegin AND r.mcend)')
def unranged_ions(spark, sf_dir):
    return ranging.unranged(hits(spark, sf_dir), ranges(spark, LAPPED)).agg(F.count(F.lit(1)).alias("n"), F.sum("ionIdx").alias("keys"))


@query(f"""SELECT a."rangeName" AS a, b."rangeName" AS b, CASE WHEN a.mcbegin <= b.mcbegin AND a.mcend >= b.mcend OR b.mcbegin <= a.mcbegin AND b.mcend >= a.mcend THEN 'cover' ELSE 'partial' END AS kind
FROM (SELECT * FROM {range_sql(LAPPED)}) a JOIN (SELECT * FROM {range_sql(LAPPED)}) b ON a."rangeName" < b."rangeName" AND a.mcbegin <= b.mcend AND b.mcbegin <= a.mcend""")
def range_overlaps(spark, sf_dir):
    return ranging.overlaps(ranges(spark, LAPPED)).select("a", "b", "kind")


@query(f'SELECT ion, "chargeState", min(mc) AS mcbegin, max(mc) AS mcend, count(*) AS n FROM {PRICES} GROUP BY 1, 2')
def range_extents(spark, sf_dir):
    return ranging.extents(prices(spark, sf_dir), "ion", "chargeState")


NAMES = "p_size::VARCHAR || 'Fe' || (p_partkey % 3 + 1)::VARCHAR || ' 16O' || CASE WHEN p_partkey % 2 = 0 THEN ' ++' ELSE ' +' END"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    sign = F.when(F.col("p_partkey") % 2 == 0, " ++").otherwise(" +")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(text(F.col("p_size")), F.lit("Fe"), text(F.col("p_partkey") % 3 + 1), F.lit(" 16O"), sign).alias("name"))


@query(f"""WITH p AS (SELECT p_partkey, p_size, {NAMES} AS name FROM part)
SELECT name, 'Fe' || (p_partkey % 3 + 1)::VARCHAR || ' O' AS ionic, p_size::VARCHAR || 'Fe' || (p_partkey % 3 + 1)::VARCHAR || ' 16O' AS isotopic, 'Fe O' AS atomic,
CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS charge, count(*) AS n FROM p GROUP BY ALL""")
def ion_names(spark, sf_dir):
    rows = named(spark, sf_dir)
    kinds = {m: ions.reduce_name(F.col("name"), m) for m in ("ionic", "isotopic", "atomic")}
    return rows.select("name", *(c.alias(m) for m, c in kinds.items()), ions.charge_of(F.col("name")).alias("charge")).groupBy("name", *kinds, "charge").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT atom, isotope, sum(n)::BIGINT AS n, sum(n)::DOUBLE / sum(sum(n)) OVER () AS share FROM (
SELECT 'Fe' AS atom, p_size AS isotope, (p_partkey % 3 + 1) AS n FROM part UNION ALL SELECT 'O', 16, 1 FROM part) GROUP BY 1, 2""")
def decomposed_atoms(spark, sf_dir):
    from pyspark.sql import Window

    rows = ranging.decompose(named(spark, sf_dir).withColumn("ion", ions.atoms_of(F.col("name"))))
    counts = rows.groupBy("atom", "isotope").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


@query(f"SELECT p_partkey AS \"ionIdx\", {NAMES} AS name FROM part")
def undecomposed_ions(spark, sf_dir):
    rows = ranging.decompose(named(spark, sf_dir).withColumn("ion", ions.atoms_of(F.col("name")))).withColumnRenamed("p_partkey", "ionIdx")
    return ranging.undecompose(rows).select("ionIdx", "name")


# Bins and composition


@query("""WITH c AS (SELECT floor(l_quantity / 10)::BIGINT AS bin_l_quantity, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY bin_l_quantity) AS share FROM c""")
def profile_1d(spark, sf_dir):
    return bins.cell_composition(bins.grid(table(spark, sf_dir, "lineitem"), [("l_quantity", 10.0)], "l_returnflag"), ["bin_l_quantity"])


@query("""WITH c AS (SELECT floor(l_quantity / 10)::BIGINT AS bin_l_quantity, floor(l_extendedprice / 20000)::BIGINT AS bin_l_extendedprice, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY bin_l_quantity, bin_l_extendedprice) AS share FROM c""")
def map_2d(spark, sf_dir):
    cells = bins.grid(table(spark, sf_dir, "lineitem"), [("l_quantity", 10.0), ("l_extendedprice", 20000.0)], "l_returnflag")
    return bins.cell_composition(cells, ["bin_l_quantity", "bin_l_extendedprice"])


@query(f"SELECT floor(x / 2)::BIGINT AS i, floor(y / 2)::BIGINT AS j, floor(z / 2)::BIGINT AS k, count(*) AS n, count(*) FILTER (WHERE label = 3) AS solute, (count(*) FILTER (WHERE label = 3))::DOUBLE / count(*) AS value FROM {POINTS} GROUP BY ALL")
def voxel_concentration(spark, sf_dir):
    return volume.voxels(points(spark, sf_dir), ["x", "y", "z"], 2.0, F.col("label") == 3)


@query(f"""WITH v AS (SELECT floor(x / 2) AS i, floor(y / 2) AS j, floor(z / 2) AS k, avg(CASE WHEN label = 3 THEN 1.0 ELSE 0 END) AS value FROM {POINTS} GROUP BY ALL)
SELECT floor(i / 2)::BIGINT AS i, floor(j / 2)::BIGINT AS j, floor(k / 2)::BIGINT AS k, round(avg(value), 9) AS value FROM v GROUP BY ALL""")
def volume_downsampled(spark, sf_dir):
    return volume.downsample(voxel_concentration(spark, sf_dir), 2).withColumn("value", F.round("value", 9))


@query("""WITH r AS (SELECT (row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1) // 500 AS slice, l_extendedprice FROM lineitem)
SELECT slice::BIGINT AS slice, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM r GROUP BY 1""")
def equal_count_slices(spark, sf_dir):
    # The SQL leaves rows that share all three columns in any order; the price settles it, so every run cuts alike.
    rows = bins.equal_count(table(spark, sf_dir, "lineitem"), 500, ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"], F.to_date("l_shipdate"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@query("""WITH s AS (SELECT floor(event_id / 50)::BIGINT AS s, value FROM events), e AS (SELECT s AS slice, value FROM s UNION ALL SELECT s - 1, value FROM s WHERE s > 0)
SELECT slice, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1""")
def overlapping_slices(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("value", bins.half_overlapping(F.col("event_id"), 100).alias("slice"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE / count(*) AS "ratio_O", count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE / count(*) AS "ratio_F" FROM lineitem GROUP BY 1""")
def charge_state_ratio(spark, sf_dir):
    return composition.charge_state_ratio(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])


@query("""WITH s AS (SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE / count(*) AS r FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(33.0 * (1 - 0.5 / (power(r, 0.3) + 0.5 + 0.256)), 9) AS field FROM s""")
def field_strength(spark, sf_dir):
    found = charge_state_ratio(spark, sf_dir)
    return found.select("l_returnflag", F.round(physics.evaporation_field(F.col("ratio_O"), 33.0, 0.5), 9).alias("field"))


@query("""WITH c AS (SELECT l_returnflag, count(*) AS k, (SELECT count(*) FROM lineitem) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(k::DOUBLE / n, 12) AS share, round(sqrt(k) / n, 12) AS poisson, round(sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n), 12) AS binomial FROM c""")
def counting_uncertainty(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    counts = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))
    a, b = (composition.uncertainty(F.col("k"), F.col("n"), m) for m in ("poisson", "binomial"))
    return counts.select("l_returnflag", F.round(a["share"], 12).alias("share"), F.round(a["sigma"], 12).alias("poisson"), F.round(b["sigma"], 12).alias("binomial"))


@query()
def exact_uncertainty(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    counts = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))
    return counts.select("l_returnflag", composition.uncertainty(F.col("k"), F.col("n"), "clopper-pearson").alias("u")).select("l_returnflag", "u.*")


@query(f"""WITH c AS (SELECT r."rangeName", count(p.mc) AS count, 2 * 40.0 * (sqrt(any_value(r.mcend)) - sqrt(any_value(r.mcbegin))) AS background FROM {range_sql(RANGES)} LEFT JOIN {PRICES} p ON p.mc BETWEEN r.mcbegin AND r.mcend GROUP BY 1),
d AS (SELECT *, greatest(count - background, 0.0) AS corrected FROM c)
SELECT "rangeName", round(background, 6) AS background, count, round(corrected, 6) AS corrected, round(corrected / sum(corrected) OVER (), 9) AS concentration FROM d""")
def background_removed(spark, sf_dir):
    table_ = ranges(spark, RANGES)
    out = composition.background_removed(ranging.allocate_disjoint(prices(spark, sf_dir), table_).filter("rangeName is not null"), table_, 40.0)
    return out.select("rangeName", F.round("background", 6).alias("background"), "count", F.round("corrected", 6).alias("corrected"), F.round("concentration", 9).alias("concentration"))


@query("""SELECT t.k AS species, count(l.l_orderkey) AS count FROM (SELECT unnest(range(0, 60)) AS k) t LEFT JOIN lineitem l ON l.l_quantity::BIGINT = t.k GROUP BY 1""")
def counts_with_zero(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("species")).agg(F.count(F.lit(1)).alias("count"))
    return composition.with_zero_categories(counts, spark.range(60).withColumnRenamed("id", "species"))


@query(f'SELECT ion, "chargeState", count(*) AS n FROM {PRICES} GROUP BY 1, 2')
def species_groups(spark, sf_dir):
    return composition.species_groups(prices(spark, sf_dir), "ion", charge="chargeState")


@query()
def stratified_sample(spark, sf_dir):
    return composition.stratified_sample(prices(spark, sf_dir), "ion", {"A": 0.5, "N": 200, "R": 1.0}, "ionIdx", 7)


@query(f"""WITH b AS (SELECT ion, floor(mc / 0.5)::BIGINT AS bin, count(*) AS counts FROM {PRICES} GROUP BY ALL) SELECT *, counts::DOUBLE / sum(counts) OVER (PARTITION BY ion) AS share FROM b""")
def spectrum_comparison(spark, sf_dir):
    return spectrum.compare(prices(spark, sf_dir), "ion", "mc", 0.5)


@query("""WITH c AS (SELECT l_linenumber, floor(l_quantity)::BIGINT AS bin, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), g AS (SELECT bin, sum(n) AS g FROM c GROUP BY 1)
SELECT l_linenumber, sum(n)::BIGINT AS atoms, round(sum(n * g) / (sqrt(sum(n * n)) * (SELECT sqrt(sum(g * g)) FROM g)), 9) AS similarity FROM c JOIN g USING (bin) GROUP BY 1""")
def voxel_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("bin", F.floor("l_quantity"))
    return bins.voxel_similarity(rows, ["l_linenumber"], "bin").withColumn("similarity", F.round("similarity", 9))


# Order


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 4) AS prefix FROM events")
def prefix_sums(spark, sf_dir):
    rows = ordered.prefix_sum(table(spark, sf_dir, "events"), F.col("value"), "event_id", 500)
    return rows.select("event_id", F.round("prefix", 4).alias("prefix"))


@query("""WITH b AS (SELECT floor(value / 5)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1), m AS (SELECT *, min(n) OVER w AS moving_min, avg(n) OVER w AS moving_mean, quantile_cont(n, 0.5) OVER w AS moving_median, quantile_cont(n, 0.2) OVER w AS moving_quantile FROM b WINDOW w AS (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT bin, n, moving_min, round(moving_mean, 6) AS moving_mean, moving_median, round(moving_quantile, 6) AS moving_quantile, quantile_cont(abs(n - moving_median), 0.5) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS moving_mad FROM m""")
def moving_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.floor(F.col("value") / 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = ordered.moving(rows, "n", 2, "bin", quantile=0.2)
    return out.withColumn("moving_mean", F.round("moving_mean", 6)).withColumn("moving_quantile", F.round("moving_quantile", 6))


@query("""WITH g AS (SELECT user_id, epoch(ts)::DOUBLE AS t, value, event_id FROM events), r AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 86400 THEN 1 ELSE 0 END AS f FROM g),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run FROM r)
SELECT user_id, run, min(t) AS first, max(t) AS last, count(*) AS n FROM s GROUP BY 1, 2""")
def gap_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "value", (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)") / 1e6).alias("t"))
    return ordered.merge_gaps(rows, "t", 86400.0, ["user_id"])


@query("""WITH b AS (SELECT floor(value / 5)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1)
SELECT bin, n, coalesce(n < lag(n) OVER w AND n <= lead(n) OVER w, false) AS is_min, coalesce(n > lag(n) OVER w AND n >= lead(n) OVER w, false) AS is_max FROM b WINDOW w AS (ORDER BY bin)""")
def local_extrema(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.floor(F.col("value") / 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return ordered.local_extrema(rows, "n", "bin").select("bin", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("is_min", "is_max")))


@query("""SELECT event_id, user_id, o.o_orderkey, o.o_totalprice FROM (SELECT *, ts AS t FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.t >= o.o_orderdate""")
def asof_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max(F.struct("o_orderkey", "o_totalprice")).alias("o")).select("user_id", "o_orderdate", "o.*")
    return ordered.asof(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), orders, "user_id", "ts", "o_orderdate", ["o_orderkey", "o_totalprice"]).drop("ts")


@query("""SELECT o.o_orderkey, round(avg(e.value), 6) AS mean, count(e.value) AS n FROM orders o LEFT JOIN events e ON e.ts BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 6 HOUR GROUP BY 1""")
def interval_mean(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("begin"), (F.col("o_orderdate") + F.expr("INTERVAL 6 HOURS")).alias("end"))
    out = ordered.between_mean(spans, "o_orderkey", "begin", "end", table(spark, sf_dir, "events"), "ts", "value")
    return out.select("o_orderkey", F.round("mean", 6).alias("mean"), "n")


@query("""SELECT floor(event_id / 200)::BIGINT AS block, count(*) AS ions, count(*) FILTER (WHERE value BETWEEN 20 AND 60) AS hits, round(count(*) FILTER (WHERE value BETWEEN 20 AND 60) / (count(*) * 40.0), 12) AS rate, round(sqrt(count(*) FILTER (WHERE value BETWEEN 20 AND 60)) / (count(*) * 40.0), 12) AS error FROM events GROUP BY 1""")
def background_blocks(spark, sf_dir):
    out = ordered.background_blocks(table(spark, sf_dir, "events"), "value", "event_id", 20.0, 60.0, 200)
    return out.withColumn("rate", F.round("rate", 12)).withColumn("error", F.round("error", 12))


@query("""WITH m AS (SELECT c.c_custkey, s.s_suppkey, s.s_acctbal, abs(c.c_acctbal - s.s_acctbal) AS gap, row_number() OVER (PARTITION BY c.c_custkey ORDER BY abs(c.c_acctbal - s.s_acctbal), s.s_acctbal) AS k FROM customer c JOIN supplier s ON abs(c.c_acctbal - s.s_acctbal) <= 40)
SELECT c.c_custkey, m.s_suppkey, round(m.gap, 6) AS gap FROM customer c LEFT JOIN m ON m.c_custkey = c.c_custkey AND m.k = 1""")
def tolerance_join(spark, sf_dir):
    found = ranging.nearest_within(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", table(spark, sf_dir, "supplier").select("s_acctbal", "s_suppkey"), "s_acctbal", 40.0, ["c_custkey"])
    return found.select("c_custkey", "s_suppkey", F.round("gap", 6).alias("gap"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem GROUP BY 1")
def regression(spark, sf_dir):
    out = calibration.regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 9).alias("r2"))


# Space


@query(f"SELECT a.vec_id, count(*) AS n, round(sum(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)), 5) AS total FROM {POINTS} a JOIN {POINTS} b ON (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 0.36 GROUP BY 1")
def radius_join(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.within(p, p, "vec_id", ["x", "y", "z"], 0.6).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 5).alias("total"))


@query(f"""WITH d AS (SELECT a.vec_id, b.vec_id AS other, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS distance FROM {POINTS} a JOIN {POINTS} b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS rank FROM d)
SELECT vec_id, other, round(distance, 6) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def nearest_neighbours(spark, sf_dir):
    return spatial.nearest(points(spark, sf_dir), "vec_id", ["x", "y", "z"], 3, 0.5).select("vec_id", "other", F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH d AS (SELECT sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d FROM {POINTS} a JOIN {POINTS} b ON a.vec_id <> b.vec_id), s AS (SELECT floor(d / 0.2)::BIGINT AS bin, count(*) AS pairs FROM d WHERE d < 1 GROUP BY 1)
SELECT bin, round((bin + 0.5) * 0.2, 9) AS r, pairs, round(pairs / ((SELECT count(*) FROM embeddings) * 0.5 * 4 / 3 * pi() * (((bin + 1) * 0.2)**3 - (bin * 0.2)**3)), 6) AS g FROM s""")
def pair_correlation(spark, sf_dir):
    out = spatial.pair_correlation(points(spark, sf_dir), "vec_id", ["x", "y", "z"], 1.0, 0.2, 0.5)
    return out.select("bin", F.round("r", 9).alias("r"), "pairs", F.round("g", 6).alias("g"))


@query(f"""WITH d AS (SELECT sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d FROM {POINTS} a JOIN {POINTS} b ON a.vec_id <> b.vec_id), r AS (SELECT unnest([0.3, 0.6, 0.9])::DOUBLE AS r), p AS (SELECT r, (SELECT count(*) FROM d WHERE d <= r) AS pairs FROM r)
SELECT r, pairs, round(pairs * 1000.0 / (SELECT count(*) FROM embeddings)**2, 6) AS "K", round(power(pairs * 1000.0 / (SELECT count(*) FROM embeddings)**2 * 3 / 4 / pi(), 1.0::DOUBLE / 3) - r, 6) AS "L" FROM p""")
def ripley_functions(spark, sf_dir):
    out = spatial.ripley(points(spark, sf_dir), "vec_id", ["x", "y", "z"], [0.3, 0.6, 0.9], 1000.0)
    return out.select("r", "pairs", F.round("K", 6).alias("K"), F.round("L", 6).alias("L"))


NEAR = f"SELECT a.vec_id AS src, b.vec_id AS dst FROM {POINTS} a JOIN {POINTS} b ON (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 0.16"


@query(f"""WITH RECURSIVE e AS ({NEAR}), c(node, reach) AS (SELECT src, dst FROM e UNION SELECT c.node, e.dst FROM c JOIN e ON c.reach = e.src) SELECT node, min(reach) AS component FROM c GROUP BY 1""")
def connected_components(spark, sf_dir):
    p = points(spark, sf_dir)
    pairs = spatial.within(p, p, "vec_id", ["x", "y", "z"], 0.4)
    return spatial.connected_components(pairs.select(F.col("vec_id").alias("src"), F.col("other").alias("dst")))


@query(f"""WITH RECURSIVE e AS ({NEAR}), k AS (SELECT src FROM e GROUP BY 1 HAVING count(*) >= 4), l AS (SELECT e.src, e.dst FROM e JOIN k a ON e.src = a.src JOIN k b ON e.dst = b.src),
c(node, reach) AS (SELECT src, dst FROM l UNION SELECT c.node, l.dst FROM c JOIN l ON c.reach = l.src), m AS (SELECT node, min(reach) AS component FROM c GROUP BY 1), n AS (SELECT node, dense_rank() OVER (ORDER BY component) AS cluster FROM m),
b AS (SELECT e.dst AS node, min(n.cluster) AS cluster FROM e JOIN n ON e.src = n.node GROUP BY 1)
SELECT p.vec_id, coalesce(n.cluster, b.cluster, -1)::BIGINT AS cluster, n.node IS NOT NULL AS is_core FROM embeddings p LEFT JOIN n ON n.node = p.vec_id LEFT JOIN b ON b.node = p.vec_id""")
def dbscan(spark, sf_dir):
    return spatial.dbscan(points(spark, sf_dir), "vec_id", ["x", "y", "z"], 0.4, 4)


@query(f"SELECT label AS cluster, count(*) AS size, round(avg(x), 6) AS centre_x, round(avg(y), 6) AS centre_y, round(avg(z), 6) AS centre_z, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rms_radius FROM {POINTS} WHERE label > 0 GROUP BY 1")
def cluster_statistics(spark, sf_dir):
    out = spatial.cluster_statistics(points(spark, sf_dir), ["x", "y", "z"], "label").withColumnRenamed("label", "cluster")
    return out.select("cluster", "size", *(F.round(c, 6).alias(c) for c in ("centre_x", "centre_y", "centre_z", "rms_radius")))


@query("""WITH a AS (SELECT n AS size, count(*) AS k FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey) GROUP BY 1), b AS (SELECT n AS size, count(*) AS k FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey % 97) GROUP BY 1),
p AS (SELECT size, k / ((coalesce(lead(size) OVER (ORDER BY size), size + 1) - coalesce(lag(size) OVER (ORDER BY size), size - 1)) / 2.0) AS v FROM a), q AS (SELECT size, k / ((coalesce(lead(size) OVER (ORDER BY size), size + 1) - coalesce(lag(size) OVER (ORDER BY size), size - 1)) / 2.0) AS v FROM b)
SELECT coalesce(p.size, q.size) AS size, round(coalesce(p.v, 0), 9) AS experiment, round(coalesce(q.v, 0), 9) AS random, round(CASE WHEN q.v > 0 THEN coalesce(p.v, 0) / q.v END, 9) AS ratio FROM p FULL JOIN q ON p.size = q.size""")
def cluster_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    sizes = lambda key: rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("size"))
    out = spatial.size_distribution(sizes(F.col("l_suppkey")), sizes(F.col("l_partkey") % 97))
    return out.select("size", *(F.round(c, 9).alias(c) for c in ("experiment", "random", "ratio")))


ANCHORS = [(0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 0.0), (2, -1.0, 0.5, 1.0), (3, 0.0, -2.0, 1.5)]
ANCHOR_SQL = "(VALUES " + ", ".join(f"({i}, {x}, {y}, {z})" for i, x, y, z in ANCHORS) + ") AS v(vid, x, y, z)"
NEAREST = f"(SELECT p.vec_id, p.label, p.z, arg_min(v.vid, sqrt((p.x-v.x)**2 + (p.y-v.y)**2 + (p.z-v.z)**2))::BIGINT AS closest, min(sqrt((p.x-v.x)**2 + (p.y-v.y)**2 + (p.z-v.z)**2)) AS distance FROM {POINTS} p, {ANCHOR_SQL} GROUP BY ALL)"


@query(f"SELECT vec_id, closest, round(distance, 9) AS distance FROM {NEAREST}")
def nearest_vertex(spark, sf_dir):
    anchors = spark.createDataFrame(ANCHORS, "vid long, x double, y double, z double")
    return spatial.nearest_anchor(points(spark, sf_dir), anchors, ["x", "y", "z"], "vid", "vec_id").select("vec_id", "closest", F.round("distance", 9).alias("distance"))


@query(f"""WITH s AS (SELECT floor((n.z - v.z) / 0.5)::BIGINT AS bin, n.label::VARCHAR AS species FROM {NEAREST} n JOIN {ANCHOR_SQL} ON v.vid = n.closest)
, c AS (SELECT bin, species, count(*) AS n FROM s GROUP BY ALL)
SELECT bin, species, n, (bin + 0.5) * 0.5 AS distance, n::DOUBLE / sum(n) OVER (PARTITION BY bin) AS share FROM c""")
def proxigram(spark, sf_dir):
    return mesh.proxigram(_signed(spark, sf_dir), "species", 0.5)


def _signed(spark, sf_dir):
    anchors = spark.createDataFrame(ANCHORS, "vid long, x double, y double, z double")
    normals = anchors.select("vid", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return mesh.signed_distance(points(spark, sf_dir), anchors, normals, "vec_id").withColumn("species", F.col("label").cast("string"))


@query(f"""SELECT n.closest AS vid, count(*) AS n, count(*) FILTER (WHERE n.label = 3) AS solute, (count(*) FILTER (WHERE n.label = 3))::DOUBLE / count(*) AS share FROM {NEAREST} n JOIN {ANCHOR_SQL} ON v.vid = n.closest WHERE n.z - v.z BETWEEN -1 AND 1 GROUP BY 1""")
def surface_concentration(spark, sf_dir):
    return mesh.surface_map(_signed(spark, sf_dir), F.col("label") == 3, 1.0, -1.0)


@query("""WITH f AS (SELECT l_orderkey * 8 + l_linenumber AS fid, l_orderkey AS v0, l_partkey AS v1, l_suppkey AS v2 FROM lineitem), e AS (SELECT least(v0, v1) AS src, greatest(v0, v1) AS dst FROM f UNION ALL SELECT least(v1, v2), greatest(v1, v2) FROM f UNION ALL SELECT least(v2, v0), greatest(v2, v0) FROM f)
SELECT src, dst FROM e GROUP BY 1, 2 HAVING count(*) = 1""")
def boundary_edges(spark, sf_dir):
    faces = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"), *(F.col(c).alias(v) for v, c in (("v0", "l_orderkey"), ("v1", "l_partkey"), ("v2", "l_suppkey"))))
    return mesh.boundary_edges(faces)


@query(f"""SELECT vec_id, x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1 AND z BETWEEN -1 AND 1 AS box, x*x + y*y + z*z <= 1.44 AS sphere, x*x + y*y <= 1 AND z BETWEEN -2 AND 2 AS cylinder,
x >= 0 AND y >= 0 AND z >= 0 AND x + y + z <= 2 AS tetrahedron, x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1 AS polygon FROM {POINTS}""")
def regions_of_interest(spark, sf_dir):
    import numpy as np

    x, y, z = F.col("x"), F.col("y"), F.col("z")
    corners = np.array([[0, 0, 0], [2, 0, 0], [0, 2, 0], [0, 0, 2]], float)
    return points(spark, sf_dir).select(
        "vec_id",
        geometry.in_box(x, y, z, (-1, -1, -1), (1, 1, 1)).alias("box"),
        geometry.in_sphere(x, y, z, (0, 0, 0), 1.2).alias("sphere"),
        geometry.in_cylinder(x, y, z, (0, 0, 0), 1, 4).alias("cylinder"),
        geometry.in_hull(x, y, z, corners).alias("tetrahedron"),
        geometry.point_in_polygon(x, y, [(-1, -1), (1, -1), (1, 1), (-1, 1)]).alias("polygon"),
    )


@query(f"""SELECT vec_id, round(x * cos(pi() / 6) - y * sin(pi() / 6), 9) AS x, round(x * sin(pi() / 6) + y * cos(pi() / 6), 9) AS y, round(z, 9) AS z FROM {POINTS}""")
def rotated_points(spark, sf_dir):
    import math

    turned = geometry_rotate(math.pi / 6)
    return points(spark, sf_dir).select("vec_id", *(F.round(c, 9).alias(n) for c, n in zip(turned, "xyz")))


def geometry_rotate(angle: float):
    return physics.rotate(F.col("x"), F.col("y"), F.col("z"), (0, 0, 1), angle)


@query(f"""WITH f AS (SELECT vec_id, list_sort([abs(x), abs(y), abs(z)]) AS s FROM {POINTS}), c AS (SELECT vec_id, s[3] - s[2] AS r, (s[2] - s[1]) * sqrt(2) AS g, s[1] * sqrt(3) AS b FROM f)
SELECT vec_id, round(r / greatest(r, g, b), 9) AS r, round(g / greatest(r, g, b), 9) AS g, round(b / greatest(r, g, b), 9) AS b FROM c""")
def ipf_colours(spark, sf_dir):
    rows = points(spark, sf_dir).select("vec_id", crystal.ipf_colour(F.col("x"), F.col("y"), F.col("z")).alias("c"))
    return rows.select("vec_id", *(F.round(f"c.{c}", 9).alias(c) for c in "rgb"))


# Physics


RAW = '(SELECT event_id AS "ionIdx", 100 + value AS tof, 3000 + event_id / 100 AS "VDC", (user_id % 41 - 20)::DOUBLE AS detx, (event_id % 31 - 15)::DOUBLE AS dety FROM events)'


def raw(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "events").select(c("event_id").alias("ionIdx"), (100 + c("value")).alias("tof"), (3000 + c("event_id") / 100).alias("VDC"), (c("user_id") % 41 - 20).cast("double").alias("detx"), (c("event_id") % 31 - 15).cast("double").alias("dety"))


@query(f"""WITH m AS (SELECT "ionIdx", "VDC" * (2 * 1.602176634e-19 / 1.66053906660e-27) * power((tof - 5) * 1e-9 / (sqrt(detx*detx + dety*dety + 12100) * 1e-3), 2) AS mc, tof FROM {RAW})
SELECT floor(mc / 10)::BIGINT AS bin, count(*) AS n FROM m GROUP BY 1""")
def mass_to_charge(spark, sf_dir):
    rows = raw(spark, sf_dir)
    mc = physics.tof_to_mc(F.col("tof"), F.col("VDC"), F.col("detx"), F.col("dety"), 110.0, 5.0)
    return rows.groupBy(F.floor(mc / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT "ionIdx", "VDC" / (65.0 * 3.3) AS r, atan(sqrt(detx*detx + dety*dety) / 110.0) AS t, atan2(dety, detx) AS a FROM {RAW}), q AS (SELECT *, t + asin(0.65 * sin(t)) AS u, 1.0 / 60.2 / 0.82 / (4536.459791783661 / power(110.0 / 1.65 / r, 2)) AS dz FROM p),
s AS (SELECT *, sum(dz) OVER (ORDER BY "ionIdx") AS depth FROM q)
SELECT floor("ionIdx" / 500)::BIGINT AS block, round(avg(r * sin(u) * cos(a)), 6) AS x, round(avg(r * sin(u) * sin(a)), 6) AS y, round(avg(depth + r * (1 - cos(u))), 6) AS z FROM s GROUP BY 1""")
def reconstructed_positions(spark, sf_dir):
    out = reconstruction.constant_density(raw(spark, sf_dir))
    return out.groupBy(F.floor(F.col("ionIdx") / 500).alias("block")).agg(*(F.round(F.avg(c), 6).alias(c) for c in "xyz"))


# Metadata, sets, top-k


@query("SELECT event_type, (props->>'k')::INTEGER % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def metadata_values(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_quantity < 10 UNION SELECT p_partkey FROM part WHERE p_size < 20) UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity < 10 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20) UNION ALL SELECT 'except', count(*) FROM (SELECT p_partkey FROM part WHERE p_size < 20 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 10)")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_quantity < 10").select(F.col("l_partkey").alias("k"))
    b = table(spark, sf_dir, "part").filter("p_size < 20").select(F.col("p_partkey").alias("k"))
    count = lambda name, frame: frame.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    return count("union", a.union(b).distinct()).unionByName(count("intersect", a.intersect(b))).unionByName(count("except", b.subtract(a)))


@query(f'SELECT ion, max(mc) AS mc, arg_max("ionIdx", struct_pack(a := mc, b := -"ionIdx")) AS "ionIdx" FROM {PRICES} GROUP BY 1')
def argmax(spark, sf_dir):
    return prices(spark, sf_dir).groupBy("ion").agg(F.max("mc").alias("mc"), F.max_by("ionIdx", F.struct(F.col("mc"), -F.col("ionIdx"))).alias("ionIdx"))


@query(f'SELECT "ionIdx", mc FROM {PRICES} ORDER BY mc DESC, "ionIdx" LIMIT 10')
def top_ions(spark, sf_dir):
    return prices(spark, sf_dir).orderBy(F.desc("mc"), "ionIdx").limit(10).select("ionIdx", "mc")


@query("""SELECT l.l_returnflag, c.abundance, count(*) AS n FROM lineitem l LEFT JOIN (VALUES ('A', 0.25), ('N', 0.75)) AS c(flag, abundance) ON l.l_returnflag = c.flag GROUP BY ALL""")
def ion_volumes(spark, sf_dir):
    dims = spark.createDataFrame([("A", 0.25), ("N", 0.75)], "l_returnflag string, abundance double")
    return table(spark, sf_dir, "lineitem").join(ranging.small(dims), "l_returnflag", "left").groupBy("l_returnflag", "abundance").agg(F.count(F.lit(1)).alias("n"))


# Rows only: numeric methods that SQL can't express


@query()
def spectrum_peaks(spark, sf_dir):
    rows = bins.histogram(prices(spark, sf_dir), "mc", 0.5).withColumn("dataset", F.lit(1))
    return spectrum.per_spectrum(rows, "dataset", lambda mc, counts: spectrum.find_peaks(mc, counts, 0.5), spectrum.PEAKS)


@query()
def overlap_deconvolution(spark, sf_dir):
    peaks = spark.createDataFrame([("a", 5.0, 0.6), ("a", 20.0, 0.4), ("b", 20.0, 0.7), ("b", 50.0, 0.3), ("c", 35.0, 1.0)], "ion string, mc double, abundance double")
    table_ = ranges(spark, LAPPED)
    fractions = deconvolution.overlap_components(deconvolution.fractions(peaks, table_))
    return deconvolution.deconvolve(fractions, deconvolution.range_counts(hits(spark, sf_dir), table_))


@query()
def mesh_distance(spark, sf_dir):
    v, f = mesh.icosphere(1.0, 1)
    faces = pd.DataFrame({"fid": range(len(f))} | {f"{n}{c}": v[f[:, k], i] for k, n in enumerate("abc") for i, c in enumerate("xyz")})
    return mesh.point_to_mesh(points(spark, sf_dir), faces, "vec_id")


@query("SELECT floor(value / 5)::BIGINT AS bin, (floor(value / 5) + 0.5) * 5 AS mc, count(*) AS counts FROM events GROUP BY floor(value / 5)")
def streamed_spectrum(spark, sf_dir):
    return spectra.drained_spectrum(spark, f"{sf_dir}/events.parquet", "value", 5.0)
