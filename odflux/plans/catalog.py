"""Relational queries over the trip views, each with its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odflux.functions.expressions import contains, coordinate_key, daypart, geoid, quarter_day
from odflux.operators import aggregates as A
from odflux.operators import centrality, cleaning, evolution, hubs, interaction, spatial, structure, temporal
from odflux.sources import sinks, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

YEAR = 1996
THRESHOLD = 15
FLOOR = 100

DAYPART_SQL = """CASE WHEN wd >= 5 AND (hr >= 22 OR hr < 4) THEN 'late_night_weekend' WHEN wd < 5 AND hr >= 6 AND hr < 10 THEN 'am_peak'
    WHEN wd < 5 AND hr >= 16 AND hr < 20 THEN 'pm_peak' WHEN hr >= 10 AND hr < 16 THEN 'midday' WHEN hr >= 20 OR (hr >= 4 AND hr < 6) THEN 'evening' ELSE 'other' END"""
VALID_SQL = "pu BETWEEN 1 AND 263 AND do_ BETWEEN 1 AND 263 AND t1 > t0 AND date_diff('second', t0, t1) / 60.0::DOUBLE BETWEEN 1 AND 360 AND fare BETWEEN 0.01 AND 1000 AND dist BETWEEN 0 AND 100"
CLEAN_SQL = f"""{views.ORDER_TRIPS}, clean AS (
  SELECT CAST(pu AS INTEGER) AS o, CAST(do_ AS INTEGER) AS d, date_diff('second', t0, t1) / 60.0::DOUBLE AS dur, fare, total, dist, tip, CAST(rate AS INTEGER) AS rate,
    CAST(isodow(t0) - 1 AS INTEGER) AS wd, CAST(hour(t0) AS INTEGER) AS hr, CAST(month(t0) AS INTEGER) AS mo, CAST(year(t0) AS INTEGER) AS yr
  FROM raw WHERE {VALID_SQL})"""
EDGES_SQL = f"{CLEAN_SQL}, e AS (SELECT o, d, count(*) AS trips, sum(dist) AS sum_dist, sum(fare) AS sum_fare, sum(dur) AS sum_dur FROM clean GROUP BY o, d), p AS (SELECT * FROM e WHERE o <> d)"
NODES_SQL = f"""{EDGES_SQL}, {views.ZONES}, nodes AS (
  SELECT zone_id, zone, borough, service_zone, cx_ft, cy_ft, coalesce(out_strength, 0)::BIGINT AS out_strength, coalesce(out_degree, 0)::BIGINT AS out_degree,
    coalesce(in_strength, 0)::BIGINT AS in_strength, coalesce(in_degree, 0)::BIGINT AS in_degree, coalesce(self_trips, 0)::BIGINT AS self_trips
  FROM (SELECT zone_id FROM zones UNION SELECT o FROM p UNION SELECT d FROM p) LEFT JOIN zones USING (zone_id)
  LEFT JOIN (SELECT o AS zone_id, sum(trips) AS out_strength, count(*) AS out_degree FROM p GROUP BY o) USING (zone_id)
  LEFT JOIN (SELECT d AS zone_id, sum(trips) AS in_strength, count(*) AS in_degree FROM p GROUP BY d) USING (zone_id)
  LEFT JOIN (SELECT o AS zone_id, trips AS self_trips FROM e WHERE o = d) USING (zone_id))"""
SPARSE_SQL = f"{views.SPARSE_EDGES}, p AS (SELECT * FROM sparse WHERE o <> d)"
PERIOD_SQL = f"""{views.EVENT_TRIPS}, pe AS (SELECT o, d, {DAYPART_SQL} AS period, count(*) AS trips FROM ev GROUP BY ALL),
ps AS (SELECT zone_id, period, sum(outward)::BIGINT AS outward, sum(inward)::BIGINT AS inward FROM (
  SELECT o AS zone_id, period, trips AS outward, 0 AS inward FROM pe WHERE o <> d UNION ALL SELECT d, period, 0, trips FROM pe WHERE o <> d) GROUP BY ALL)"""
UNDIRECTED_SQL = "un AS (SELECT least(o, d) AS u, greatest(o, d) AS v, sum(trips)::BIGINT AS trips FROM p GROUP BY ALL)"


def off_ties(df: DataFrame) -> DataFrame:
    """Doubles moved off rounding ties, where the order of a sum would decide the last digit."""
    return df.withColumns({c: F.col(c) + 1e-7 for c, kind in df.dtypes if kind == "double"})


def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(views.order_trips(spark, sf_dir))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.edges(clean_orders(spark, sf_dir))


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nodes(order_edges(spark, sf_dir), views.zones(spark, sf_dir))


def event_period_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_period(views.event_trips(spark, sf_dir)).groupBy("o", "d", "period").agg(F.count(F.lit(1)).alias("trips"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to fixed places, so that the order of a sum doesn't show."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, base: str = "") -> Callable[[Query], Query]:
    """Register a query, and its SQL after the common table expressions in ``base``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {base}\n{sql}" if base else sql
        return f

    return add


# --- cleaning and profiles


@query(
    f"""SELECT count(*) AS raw_rows,
  count(*) FILTER (pu IS NULL OR do_ IS NULL OR pu NOT BETWEEN 1 AND 263 OR do_ NOT BETWEEN 1 AND 263) AS bad_zone,
  count(*) FILTER (t0 IS NULL OR t1 IS NULL OR t1 <= t0) AS bad_time,
  count(*) FILTER (date_diff('second', t0, t1) / 60.0::DOUBLE < 1 OR date_diff('second', t0, t1) / 60.0::DOUBLE > 360) AS bad_duration,
  count(*) FILTER (fare < 0.01 OR fare > 1000) AS bad_fare, count(*) FILTER (dist < 0 OR dist > 100) AS bad_distance,
  count(*) FILTER (year(t0) <> {YEAR}) AS out_of_year, count(*) FILTER (year(t0) = {YEAR} AND {VALID_SQL}) AS kept FROM raw""",
    views.ORDER_TRIPS,
)
def cleaning_profile(spark, sf_dir):
    return cleaning.profile(views.order_trips(spark, sf_dir), YEAR)


@query(
    f"""SELECT year, month, raw_rows, kept, round(kept * 100.0::DOUBLE / raw_rows, 3) AS kept_pct FROM (
  SELECT CAST(year(t0) AS INTEGER) AS year, CAST(CASE WHEN grouping(month(t0)) = 1 THEN 0 ELSE month(t0) END AS INTEGER) AS month, count(*) AS raw_rows, count(*) FILTER ({VALID_SQL}) AS kept
  FROM raw GROUP BY GROUPING SETS ((year(t0)), (year(t0), month(t0))))""",
    views.ORDER_TRIPS,
)
def cleaning_rollup_by_month(spark, sf_dir):
    return cleaning.monthly_profile(views.order_trips(spark, sf_dir))


@query("SELECT o, d, round(dur, 6) AS dur, round(fare, 6) AS fare, round(total, 6) AS total, dist, round(tip, 6) AS tip, rate, wd, hr, mo, yr FROM clean", CLEAN_SQL)
def clean_trips_projection(spark, sf_dir):
    return rounded(clean_orders(spark, sf_dir))


@query(f"SELECT o, d, round(date_diff('second', t0, t1) / 60.0::DOUBLE, 6) AS dur, wd, hr, mo FROM ev WHERE t1 > t0 AND date_diff('second', t0, t1) / 60.0::DOUBLE BETWEEN 1 AND 360", views.EVENT_TRIPS)
def trip_duration_filter(spark, sf_dir):
    from odflux.functions.expressions import duration_minutes

    trips = views.event_trips(spark, sf_dir).withColumn("dur", duration_minutes(F.col("t0"), F.col("t1")))
    return rounded(trips.where(F.col("dur").between(1, 360) & (F.col("t1") > F.col("t0"))).select("o", "d", "dur", "wd", "hr", "mo"))


@query(f"SELECT CAST(w.range AS INTEGER) AS wd, CAST(h.range AS INTEGER) AS hr, {DAYPART_SQL.replace('wd', 'w.range').replace('hr', 'h.range')} AS period FROM range(7) w, range(24) h")
def daypart_truth_table(spark, sf_dir):
    cells = spark.range(7 * 24).select((F.col("id") / 24).cast("int").alias("wd"), (F.col("id") % 24).cast("int").alias("hr"))
    return cells.withColumn("period", daypart(F.col("wd"), F.col("hr")))


@query("SELECT o, d, period, trips FROM pe", PERIOD_SQL)
def daypart_edges(spark, sf_dir):
    return event_period_edges(spark, sf_dir)


@query("SELECT wd, hr, count(*) AS trips FROM ev GROUP BY ALL", views.EVENT_TRIPS)
def hour_weekday_counts(spark, sf_dir):
    return A.hour_weekday(views.event_trips(spark, sf_dir))


@query(
    """SELECT zone_id, weekend, hr, coalesce(pickups, 0)::BIGINT AS pickups, coalesce(dropoffs, 0)::BIGINT AS dropoffs
FROM (SELECT o AS zone_id, wd >= 5 AS weekend, hr, count(*) AS pickups FROM ev GROUP BY ALL) FULL JOIN (SELECT d AS zone_id, wd >= 5 AS weekend, hr, count(*) AS dropoffs FROM ev GROUP BY ALL) USING (zone_id, weekend, hr)""",
    views.EVENT_TRIPS,
)
def zone_hourly_full_outer(spark, sf_dir):
    return A.zone_hourly(views.event_trips(spark, sf_dir))


@query("SELECT mo AS month, count(*) AS trips, round(sum(fare), 4) AS sum_fare, round(sum(total), 4) AS sum_total, round(sum(dist), 4) AS sum_dist, round(sum(dur), 4) AS sum_dur FROM clean GROUP BY mo", CLEAN_SQL)
def monthly_volume(spark, sf_dir):
    return rounded(A.monthly_volume(clean_orders(spark, sf_dir)), 4)


@query(
    """SELECT arg_max(month, trips * 100 - month) AS peak_month, round(avg(CASE WHEN month BETWEEN 3 AND 5 THEN trips END), 6) AS spring_mean,
  round(avg(CASE WHEN month BETWEEN 6 AND 12 THEN trips END), 6) AS later_mean,
  round((avg(CASE WHEN month BETWEEN 3 AND 5 THEN trips END) - avg(CASE WHEN month BETWEEN 6 AND 12 THEN trips END)) * 100 / avg(CASE WHEN month BETWEEN 3 AND 5 THEN trips END), 6) AS drop_pct
FROM (SELECT mo AS month, count(*) AS trips FROM clean GROUP BY mo)""",
    CLEAN_SQL,
)
def monthly_seasonality(spark, sf_dir):
    return rounded(temporal.seasonality(A.monthly_volume(clean_orders(spark, sf_dir))))


@query("SELECT CAST(least(floor(dur), 120) AS INTEGER) AS dur_bin, CAST(least(floor(fare), 120) AS INTEGER) AS fare_bin, count(*) AS n FROM clean GROUP BY ALL", CLEAN_SQL)
def cost_duration_hist(spark, sf_dir):
    return A.cost_duration_histogram(clean_orders(spark, sf_dir))


@query("SELECT CAST(floor(dur / 10) AS INTEGER) AS dur_bin, round(avg(fare), 6) AS mean_fare, count(*) AS n FROM clean WHERE dur <= 90 AND fare <= 900 GROUP BY ALL", CLEAN_SQL)
def cost_per_duration_band(spark, sf_dir):
    trips = clean_orders(spark, sf_dir).where("dur <= 90 and fare <= 900")
    return rounded(trips.groupBy(F.floor(F.col("dur") / 10).cast("int").alias("dur_bin")).agg(F.avg("fare").alias("mean_fare"), F.count(F.lit(1)).alias("n")))


@query(
    """SELECT mo, event_id FROM (SELECT *, row_number() OVER (PARTITION BY mo ORDER BY ((((0 + event_id) * 48271 + 11) % 2147483647 + user_id) * 48271 + 11) % 2147483647, event_id, user_id) AS n
  FROM (SELECT event_id, user_id, CAST(hour(ts) AS INTEGER) AS mo FROM events)) WHERE n <= 50"""
)
def deterministic_sample(spark, sf_dir):
    events = views.read(spark, sf_dir, "events").select("event_id", "user_id", F.hour("ts").alias("mo"))
    return A.hashed_sample(events, "mo", 50, "event_id", "user_id").select("mo", "event_id")


@query(
    """SELECT arg_max(wd, trips * 10000 - wd * 100 - hr) AS busiest_wd, arg_max(hr, trips * 10000 - wd * 100 - hr) AS busiest_hr,
  round(sum(CASE WHEN wd BETWEEN 0 AND 4 AND hr BETWEEN 6 AND 9 THEN trips ELSE 0 END) * 100.0::DOUBLE / sum(trips), 6) AS weekday_am_pct,
  round(sum(CASE WHEN wd BETWEEN 5 AND 6 AND hr BETWEEN 0 AND 4 THEN trips ELSE 0 END) * 100.0::DOUBLE / sum(trips), 6) AS weekend_night_pct
FROM (SELECT wd, hr, count(*) AS trips FROM ev GROUP BY ALL)""",
    views.EVENT_TRIPS,
)
def hour_weekday_shares(spark, sf_dir):
    return rounded(temporal.week_shares(A.hour_weekday(views.event_trips(spark, sf_dir))))


@query(
    """SELECT round(quantile_cont(fare, 0.25::DOUBLE), 6) AS fare_q25, round(quantile_cont(fare, 0.5::DOUBLE), 6) AS fare_q50, round(quantile_cont(fare, 0.75::DOUBLE), 6) AS fare_q75,
  count(*) FILTER (fare BETWEEN 200 AND 400) AS in_band, round(avg(CASE WHEN fare BETWEEN 200 AND 400 THEN CASE WHEN rate = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END), 6) AS rate_share FROM clean""",
    CLEAN_SQL,
)
def fare_band_quantiles(spark, sf_dir):
    return rounded(temporal.fare_band(clean_orders(spark, sf_dir), 2, 200.0, 400.0))


# --- edges and nodes


@query(
    """SELECT o, d, trips, round(sum_dist + 1e-7, 4) AS sum_dist, round(sum_fare + 1e-7, 4) AS sum_fare, round(sum_dur + 1e-7, 4) AS sum_dur,
  round(sum_dist / trips + 1e-7, 4) AS mean_dist, round(sum_fare / trips + 1e-7, 4) AS mean_fare, round(sum_dur / trips + 1e-7, 4) AS mean_dur FROM e""",
    EDGES_SQL,
)
def annual_edges(spark, sf_dir):
    monthly = A.edges(clean_orders(spark, sf_dir), "mo")
    return rounded(off_ties(A.annual(monthly)), 4)


@query("SELECT count(*) AS edges, sum(trips)::BIGINT AS annual_trips, (SELECT count(*) FROM clean) AS kept, sum(trips) = (SELECT count(*) FROM clean) AS conserved FROM e", EDGES_SQL)
def partial_sum_integrity(spark, sf_dir):
    trips = clean_orders(spark, sf_dir)
    monthly = A.annual(A.edges(trips, "mo")).agg(F.count(F.lit(1)).alias("edges"), F.sum("trips").alias("annual_trips"))
    return monthly.join(trips.agg(F.count(F.lit(1)).alias("kept"))).withColumn("conserved", F.col("annual_trips") == F.col("kept"))


@query("SELECT *, out_strength + in_strength AS total_trips, round((out_strength - in_strength) / nullif(out_strength + in_strength, 0)::DOUBLE, 6) AS net_flow_index FROM nodes", NODES_SQL)
def node_table(spark, sf_dir):
    return rounded(order_nodes(spark, sf_dir))


@query(
    f"""SELECT sum(trips)::BIGINT AS total_trips, coalesce(sum(trips) FILTER (o = d), 0)::BIGINT AS self_trips, count(*) FILTER (o <> d) AS active_edges, count(*) FILTER (o <> d AND trips > {THRESHOLD}) AS filtered_edges,
  (SELECT count(*) FROM (SELECT o FROM p UNION SELECT d FROM p)) AS active_nodes,
  (SELECT count(*) FROM (SELECT o FROM p WHERE trips > {THRESHOLD} UNION SELECT d FROM p WHERE trips > {THRESHOLD})) AS filtered_nodes,
  round(coalesce(sum(trips) FILTER (o = d), 0) * 100.0::DOUBLE / sum(trips), 6) AS self_share_pct,
  round(count(*) FILTER (o <> d) / ((SELECT count(*) FROM (SELECT o FROM p UNION SELECT d FROM p)) * ((SELECT count(*) FROM (SELECT o FROM p UNION SELECT d FROM p)) - 1))::DOUBLE, 6) AS density FROM e""",
    EDGES_SQL,
)
def graph_scalars(spark, sf_dir):
    return rounded(A.graph_scalars(order_edges(spark, sf_dir), THRESHOLD))


@query("SELECT max(out_degree) AS max_out, max(in_degree) AS max_in, round(avg(out_degree), 6) AS mean_out, round(avg(in_degree), 6) AS mean_in FROM nodes", NODES_SQL)
def degree_summary(spark, sf_dir):
    n = order_nodes(spark, sf_dir)
    return rounded(n.agg(F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"), F.avg("out_degree").alias("mean_out"), F.avg("in_degree").alias("mean_in")))


HUBS_SQL = NODES_SQL + """, hub AS (SELECT zone_id, zone, borough, in_strength, in_degree, out_strength, out_degree,
  in_strength / nullif(in_degree, 0)::DOUBLE AS trips_per_source, out_strength / nullif(out_degree, 0)::DOUBLE AS trips_per_dest FROM nodes)"""


@query(
    """SELECT zone_id, zone, in_strength, in_degree, out_strength, out_degree, round(trips_per_source, 6) AS trips_per_source, round(trips_per_dest, 6) AS trips_per_dest,
  round(trips_per_source / nullif(trips_per_dest, 0), 6) AS asymmetry FROM hub""",
    HUBS_SQL,
)
def hub_asymmetry(spark, sf_dir):
    return rounded(hubs.hub_asymmetry(order_nodes(spark, sf_dir)))


@query(
    f"""SELECT zone_id, zone, round(trips_per_source, 6) AS trips_per_source, CAST(rank() OVER (ORDER BY trips_per_source) AS INTEGER) AS rank,
  round((rank() OVER (ORDER BY trips_per_source) + (count(*) OVER (PARTITION BY trips_per_source) - 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS pct_rank
FROM hub WHERE borough = 'EUROPE' AND in_strength >= {FLOOR}""",
    HUBS_SQL,
)
def periphery_rank(spark, sf_dir):
    return rounded(hubs.periphery_rank(order_nodes(spark, sf_dir), "EUROPE", FLOOR))


@query(
    """SELECT pattern, zone_id, zone, in_strength FROM (SELECT pattern, zone_id, zone, in_strength, row_number() OVER (PARTITION BY pattern ORDER BY in_strength DESC, zone_id) AS n
  FROM nodes JOIN (VALUES ('united'), ('an'), ('ru')) v(pattern) ON contains(lower(zone), pattern)) WHERE n = 1""",
    NODES_SQL,
)
def named_hub_lookup(spark, sf_dir):
    return hubs.named_hubs(order_nodes(spark, sf_dir), ["united", "an", "ru"])


@query("SELECT zone_id, zone, regexp_matches(zone, '(?i)an|united') AS hit FROM zones", views.ZONES)
def zone_name_search(spark, sf_dir):
    return views.zones(spark, sf_dir).select("zone_id", "zone", contains(F.col("zone"), "an|united").alias("hit"))


@query("SELECT zone_id, in_strength, CAST(row_number() OVER (ORDER BY in_strength DESC, zone_id) AS INTEGER) AS rank, round(row_number() OVER (ORDER BY in_strength DESC, zone_id) / count(*) OVER ()::DOUBLE, 6) AS ccdf FROM nodes", NODES_SQL)
def ccdf(spark, sf_dir):
    return rounded(hubs.strength_curve(order_nodes(spark, sf_dir), "in_strength"))


@query(
    """SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini, round(sum(CASE WHEN j <= 10 THEN x END) / sum(x), 6) AS top_share
FROM (SELECT in_strength::DOUBLE AS x, row_number() OVER (ORDER BY in_strength, zone_id) AS i, row_number() OVER (ORDER BY in_strength DESC, zone_id) AS j FROM nodes)""",
    NODES_SQL,
)
def gini_top10_share(spark, sf_dir):
    return rounded(hubs.concentration(order_nodes(spark, sf_dir), "in_strength", 10))


@query(
    """(SELECT zone_id, in_strength, 'low' AS "end" FROM nodes ORDER BY in_strength, zone_id LIMIT 8) UNION ALL
SELECT * FROM (SELECT zone_id, in_strength, 'high' AS "end" FROM nodes ORDER BY in_strength DESC, zone_id LIMIT 8) WHERE zone_id NOT IN (SELECT zone_id FROM nodes ORDER BY in_strength, zone_id LIMIT 8)""",
    NODES_SQL,
)
def strength_extremes(spark, sf_dir):
    return hubs.extremes(order_nodes(spark, sf_dir).select("zone_id", "in_strength"), "in_strength", 8, "zone_id")


# --- dayparts


@query(
    """SELECT period, rank, zone_id, inward FROM (SELECT *, CAST(row_number() OVER (PARTITION BY period ORDER BY inward DESC, zone_id) AS INTEGER) AS rank FROM ps) WHERE rank <= 3""",
    PERIOD_SQL,
)
def daypart_top_hubs(spark, sf_dir):
    return temporal.top_hubs(event_period_edges(spark, sf_dir), 3)


@query(
    """SELECT count(*) FILTER (a AND b) AS shared, count(*) FILTER (a OR b) AS united, round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a OR b), 0)::DOUBLE, 6) AS jaccard FROM (
  SELECT zone_id, bool_or(period = 'am_peak') AS a, bool_or(period = 'late_night_weekend') AS b FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY inward DESC, zone_id) AS n FROM ps) WHERE n <= 3 GROUP BY zone_id)""",
    PERIOD_SQL,
)
def hub_jaccard(spark, sf_dir):
    return rounded(temporal.hub_overlap(event_period_edges(spark, sf_dir), "am_peak", "late_night_weekend", 3))


WIDE_SQL = PERIOD_SQL + """, wide AS (SELECT zone_id, sum(CASE WHEN period = 'am_peak' THEN outward ELSE 0 END) AS ao, sum(CASE WHEN period = 'am_peak' THEN inward ELSE 0 END) AS ai,
  sum(CASE WHEN period = 'pm_peak' THEN outward ELSE 0 END) AS po, sum(CASE WHEN period = 'pm_peak' THEN inward ELSE 0 END) AS pi FROM ps GROUP BY zone_id)"""


@query(
    """SELECT zone_id, round(a, 6) AS nfi_a, round(b, 6) AS nfi_b, coalesce(a * b < 0, false) AS flips FROM (
  SELECT zone_id, (ao - ai) / nullif(ao + ai, 0)::DOUBLE AS a, (po - pi) / nullif(po + pi, 0)::DOUBLE AS b FROM wide)""",
    WIDE_SQL,
)
def netflow_flip(spark, sf_dir):
    return rounded(temporal.flow_flip(event_period_edges(spark, sf_dir), "am_peak", "pm_peak"))


@query(
    """SELECT zone_id, ra AS rank_a, rb AS rank_b, ra - rb AS shift FROM (SELECT zone_id, rank() OVER (ORDER BY ai DESC) + (count(*) OVER (PARTITION BY ai) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (ORDER BY pi DESC) + (count(*) OVER (PARTITION BY pi) - 1) / 2.0::DOUBLE AS rb FROM wide)""",
    WIDE_SQL,
)
def dest_rank_shift(spark, sf_dir):
    return temporal.rank_shift(event_period_edges(spark, sf_dir), "am_peak", "pm_peak")


@query(
    """SELECT zone_id, hr, pickups, round(pickups / total::DOUBLE, 6) AS share FROM (SELECT o AS zone_id, hr, count(*) AS pickups, sum(count(*)) OVER (PARTITION BY o) AS total FROM ev WHERE wd < 5 GROUP BY o, hr) WHERE total >= 50""",
    views.EVENT_TRIPS,
)
def rhythm_profiles(spark, sf_dir):
    return rounded(temporal.rhythm_profiles(A.zone_hourly(views.event_trips(spark, sf_dir)).where("pickups > 0"), 50))


# --- structure


def _both(name, sql, op, base=EDGES_SQL, edges=order_edges, places=6):
    def run(spark, sf_dir):
        return rounded(op(edges(spark, sf_dir)), places)

    run.__name__ = name
    query(sql, base)(run)


_both("undirected_projection", "SELECT * FROM un", structure.undirected, f"{EDGES_SQL}, {UNDIRECTED_SQL}")
_both("weighted_reciprocity", "SELECT round(sum(least(a.trips, coalesce(b.trips, 0))) / sum(a.trips)::DOUBLE, 6) AS weighted_reciprocity FROM p a LEFT JOIN p b ON a.o = b.d AND a.d = b.o", structure.weighted_reciprocity)
for _name, _edges, _base in (("gl_reciprocity", order_edges, EDGES_SQL), ("gl_reciprocity_sparse", views.sparse_edges, SPARSE_SQL)):
    _both(
        _name,
        """SELECT links, n, round(r, 6) AS r, round(density, 6) AS density, round((r - density) / nullif(1 - density, 0), 6) AS rho FROM (SELECT links, n, m / links::DOUBLE AS r, links / (n * (n - 1))::DOUBLE AS density FROM (
  SELECT count(*) AS links, count(b.o) AS m, (SELECT count(*) FROM (SELECT o FROM p UNION SELECT d FROM p)) AS n FROM p a LEFT JOIN p b ON a.o = b.d AND a.d = b.o))""",
        structure.reciprocity,
        _base,
        _edges,
    )
_both(
    "flow_imbalance",
    """SELECT count(*) AS pairs, round(avg(x), 6) AS mean_imbalance, round(median(x), 6) AS median_imbalance FROM (SELECT abs(a.trips - b.trips) / (a.trips + b.trips)::DOUBLE AS x FROM p a JOIN p b ON a.o = b.d AND a.d = b.o WHERE a.o < a.d)""",
    structure.flow_imbalance,
)
_both(
    "assortativity",
    """SELECT round(corr(x.k, y.k), 6) AS assortativity FROM p JOIN (SELECT o, count(*) AS k FROM p GROUP BY o) x USING (o) JOIN (SELECT d, count(*) AS k FROM p GROUP BY d) y USING (d)""",
    structure.assortativity,
    SPARSE_SQL,
    views.sparse_edges,
)
_both(
    "density_kappa",
    """SELECT count(*) AS nodes, round(avg(k), 6) AS mean_degree, round(avg(k * k) / avg(k), 6) AS kappa, round(sum(k) / 2 / (count(*) * (count(*) - 1)), 6) AS density
FROM (SELECT id, count(*)::DOUBLE AS k FROM (SELECT o AS id FROM p UNION ALL SELECT d FROM p) GROUP BY id)""",
    structure.kappa,
    SPARSE_SQL,
    views.sparse_edges,
)
_both(
    "transitivity",
    """SELECT triangles, triads, round(triangles * 3 / triads::DOUBLE, 6) AS transitivity FROM (SELECT
  (SELECT count(*) FROM un a JOIN un b ON a.v = b.u JOIN un c ON c.u = a.u AND c.v = b.v) AS triangles,
  (SELECT sum(k * (k - 1) // 2)::BIGINT FROM (SELECT id, count(*) AS k FROM (SELECT u AS id FROM un UNION ALL SELECT v FROM un) GROUP BY id)) AS triads)""",
    structure.transitivity,
    f"{SPARSE_SQL}, {UNDIRECTED_SQL}",
    views.sparse_edges,
)
BACKBONE_SQL = EDGES_SQL + """, bb AS (SELECT o, d, trips, least(
  CASE WHEN count(*) OVER (PARTITION BY o) = 1 THEN 0 ELSE pow(1 - trips / (sum(trips) OVER (PARTITION BY o))::DOUBLE, count(*) OVER (PARTITION BY o) - 1) END,
  CASE WHEN count(*) OVER (PARTITION BY d) = 1 THEN 0 ELSE pow(1 - trips / (sum(trips) OVER (PARTITION BY d))::DOUBLE, count(*) OVER (PARTITION BY d) - 1) END) AS alpha FROM p)"""
_both("disparity_backbone", "SELECT o, d, trips, round(alpha, 6) AS alpha, alpha < 0.05 AS keep FROM bb", structure.backbone, BACKBONE_SQL)
_both(
    "backbone_vs_threshold",
    f"""SELECT count(*) FILTER (alpha < 0.05) AS backbone_edges, count(*) FILTER (trips > {THRESHOLD}) AS threshold_edges, count(*) FILTER (alpha < 0.05 AND trips > {THRESHOLD}) AS both_edges,
  round(coalesce(sum(trips) FILTER (alpha < 0.05), 0) / sum(trips)::DOUBLE, 6) AS backbone_share, round(coalesce(sum(trips) FILTER (trips > {THRESHOLD}), 0) / sum(trips)::DOUBLE, 6) AS threshold_share FROM bb""",
    lambda e: structure.backbone_share(e, THRESHOLD),
    BACKBONE_SQL,
)
_both(
    "rich_club",
    """SELECT pairs, rich_trips, best_trips, round(rich_trips / nullif(best_trips, 0)::DOUBLE, 6) AS phi FROM (SELECT pairs, rich_trips,
  (SELECT coalesce(sum(trips), 0)::BIGINT FROM (SELECT trips, row_number() OVER (ORDER BY trips DESC, u, v) AS n FROM un) WHERE n <= pairs) AS best_trips FROM (
  SELECT (SELECT (count(*) * (count(*) - 1) // 2)::BIGINT FROM rich) AS pairs, coalesce(sum(trips), 0)::BIGINT AS rich_trips FROM un WHERE u IN (SELECT id FROM rich) AND v IN (SELECT id FROM rich)))""",
    lambda e: structure.rich_club(e, 0.8),
    f"{EDGES_SQL}, {UNDIRECTED_SQL}, st AS (SELECT id, sum(trips) AS s FROM (SELECT u AS id, trips FROM un UNION ALL SELECT v, trips FROM un) GROUP BY id), rich AS (SELECT id FROM st WHERE s >= (SELECT quantile_cont(s::DOUBLE, 0.8::DOUBLE) FROM st))",
)


@query("SELECT o, d, trips FROM e WHERE o IN (SELECT zone_id FROM zones WHERE cx_ft IS NOT NULL) AND d IN (SELECT zone_id FROM zones WHERE cx_ft IS NOT NULL)", f"{EDGES_SQL}, {views.ZONES}")
def edges_with_geometry_semi(spark, sf_dir):
    return structure.with_geometry(order_edges(spark, sf_dir).select("o", "d", "trips"), views.zones(spark, sf_dir))


@query("SELECT o, d, trips FROM e WHERE o NOT IN (SELECT zone_id FROM zones WHERE cx_ft IS NOT NULL) OR d NOT IN (SELECT zone_id FROM zones WHERE cx_ft IS NOT NULL)", f"{EDGES_SQL}, {views.ZONES}")
def edges_without_geometry_anti(spark, sf_dir):
    return structure.without_geometry(order_edges(spark, sf_dir).select("o", "d", "trips"), views.zones(spark, sf_dir))


# --- space

MILES_SQL = "sqrt(pow(a.cx_ft - b.cx_ft, 2) + pow(a.cy_ft - b.cy_ft, 2)) / 5280"
PAIRS_SQL = f"{views.ZONES}, pd AS (SELECT a.zone_id AS o, b.zone_id AS d, {MILES_SQL} AS miles FROM zones a JOIN zones b ON a.zone_id <> b.zone_id WHERE a.cx_ft IS NOT NULL AND b.cx_ft IS NOT NULL)"


@query("SELECT o, d, round(miles, 6) AS miles FROM pd", PAIRS_SQL)
def pair_distances(spark, sf_dir):
    return rounded(interaction.pair_distances(views.zones(spark, sf_dir)))


@query("SELECT o, d, round(miles, 6) AS miles, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o ORDER BY miles, d) AS INTEGER) AS rank FROM pd) WHERE rank <= 6", PAIRS_SQL)
def knn_neighbours(spark, sf_dir):
    return rounded(interaction.nearest(views.zones(spark, sf_dir), 6))


@query(
    f"""SELECT bin, count(*) AS n, round(avg(trips), 6) AS mean_trips FROM (SELECT CAST(floor((log10({MILES_SQL}) + 1) / 0.125) AS INTEGER) AS bin, trips
  FROM p JOIN zones a ON a.zone_id = o JOIN zones b ON b.zone_id = d WHERE {MILES_SQL} > 0) WHERE bin BETWEEN 0 AND 23 GROUP BY bin""",
    f"{EDGES_SQL}, {views.ZONES}",
)
def distance_decay_bins(spark, sf_dir):
    return rounded(interaction.decay_bins(order_edges(spark, sf_dir), views.zones(spark, sf_dir)))


@query("SELECT count(*) AS pairs, round(avg(1 / miles), 6) AS ideal_efficiency FROM pd WHERE miles > 0", PAIRS_SQL)
def ideal_efficiency(spark, sf_dir):
    return rounded(interaction.ideal_efficiency(views.zones(spark, sf_dir)))


@query(
    """SELECT n, round(num / nullif(den, 0), 6) AS morans_i, round(-1 / (n - 1)::DOUBLE, 6) AS expected FROM (SELECT (SELECT count(*) FROM z) AS n, sum(a.x * b.x) / 6 AS num,
  (SELECT sum(x * x) FROM z) AS den FROM nn JOIN z a ON a.zone_id = nn.o JOIN z b ON b.zone_id = nn.d)""",
    f"{NODES_SQL}, {PAIRS_SQL.split(', pd', 1)[0] and 'pd' + PAIRS_SQL.split(', pd', 1)[1]}, nn AS (SELECT o, d FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY miles, d) AS k FROM pd) WHERE k <= 6), "
    "z AS (SELECT zone_id, total - avg(total) OVER () AS x FROM (SELECT zone_id, (in_strength + out_strength)::DOUBLE AS total FROM nodes WHERE cx_ft IS NOT NULL))",
)
def morans_i_observed(spark, sf_dir):
    return rounded(spatial.morans_i(order_nodes(spark, sf_dir), views.zones(spark, sf_dir), "total_trips", 6))


# --- interaction with fixed rounds

BETA, ROUNDS = 0.8, 3


def _furness_sql() -> str:
    out = f"""{EDGES_SQL}, {views.ZONES}, de AS (SELECT o, d, trips, {MILES_SQL} AS miles FROM p JOIN zones a ON a.zone_id = o JOIN zones b ON b.zone_id = d WHERE {MILES_SQL} > 0),
ot AS (SELECT o, sum(trips)::DOUBLE AS ot FROM de GROUP BY o), dt AS (SELECT d, sum(trips)::DOUBLE AS dt FROM de GROUP BY d),
g AS (SELECT o, d, ot, dt, {MILES_SQL} AS miles, pow({MILES_SQL}, -{BETA}::DOUBLE) AS f FROM ot JOIN dt ON o <> d JOIN zones a ON a.zone_id = o JOIN zones b ON b.zone_id = d WHERE {MILES_SQL} > 0),
b0 AS (SELECT d, 1.0::DOUBLE AS b FROM dt)"""
    for k in range(1, ROUNDS + 1):
        out += f", a{k} AS (SELECT o, 1 / sum(b * dt * f) AS a FROM g JOIN b{k - 1} USING (d) GROUP BY o), b{k} AS (SELECT d, 1 / sum(a * ot * f) AS b FROM g JOIN a{k} USING (o) GROUP BY d)"
    return out + f", fm AS (SELECT g.o, g.d, coalesce(trips, 0) AS obs, g.miles, a * b * ot * dt * f AS model FROM g JOIN a{ROUNDS} USING (o) JOIN b{ROUNDS} ON b{ROUNDS}.d = g.d LEFT JOIN de ON de.o = g.o AND de.d = g.d)"


FURNESS_SQL = _furness_sql()
RESID_SQL = FURNESS_SQL + """, res AS (SELECT *, sign(obs - model) * sqrt(greatest(2 * (CASE WHEN obs > 0 THEN obs * ln(obs / model) ELSE 0 END - (obs - model)), 0)) AS resid FROM fm WHERE model >= 5)"""


def order_furness(spark, sf_dir):
    return interaction.furness(order_edges(spark, sf_dir), views.zones(spark, sf_dir), BETA, ROUNDS)


def order_residuals(spark, sf_dir):
    return interaction.deviance_residuals(order_furness(spark, sf_dir), 5.0)


@query("SELECT o, d, obs, round(miles, 4) AS miles, round(model, 4) AS model FROM fm", FURNESS_SQL)
def furness_fixed_beta(spark, sf_dir):
    return rounded(order_furness(spark, sf_dir), 4)


@query("SELECT round(2 * sum(least(obs, model)) / (sum(obs) + sum(model)), 6) AS cpc FROM fm", FURNESS_SQL)
def common_part_of_commuters(spark, sf_dir):
    return rounded(interaction.common_part(order_furness(spark, sf_dir)))


@query("SELECT round(sum(model * miles) / sum(model) - sum(obs * miles) / sum(obs), 6) AS gap FROM fm", FURNESS_SQL)
def mean_miles_gap(spark, sf_dir):
    return rounded(interaction.mean_miles_gap(order_furness(spark, sf_dir)))


@query("SELECT o, d, obs, round(miles, 4) AS miles, round(model, 4) AS model, round(resid, 4) AS resid FROM res", RESID_SQL)
def deviance_residuals(spark, sf_dir):
    return rounded(order_residuals(spark, sf_dir), 4)


@query(
    """SELECT zone_id, round(outward, 4) AS outward, round(inward, 4) AS inward, round(coalesce((outward + inward) / 2, outward, inward), 4) AS surprise
FROM (SELECT o AS zone_id, avg(resid) AS outward FROM res GROUP BY o) FULL JOIN (SELECT d AS zone_id, avg(resid) AS inward FROM res GROUP BY d) USING (zone_id)""",
    RESID_SQL,
)
def zone_surprise(spark, sf_dir):
    return rounded(interaction.surprise(order_residuals(spark, sf_dir)), 4)


SURPRISE_SQL = RESID_SQL + """, su AS (SELECT zone_id, coalesce((outward + inward) / 2, outward, inward) AS surprise
FROM (SELECT o AS zone_id, avg(resid) AS outward FROM res GROUP BY o) FULL JOIN (SELECT d AS zone_id, avg(resid) AS inward FROM res GROUP BY d) USING (zone_id)),
core AS (SELECT zone_id, surprise FROM su JOIN zones USING (zone_id) WHERE service_zone IN ('Yellow Zone', 'Airports'))"""


@query(
    """SELECT zone_id, round(surprise, 4) AS surprise, round((row_number() OVER (ORDER BY surprise, zone_id) - 1) / count(*) OVER ()::DOUBLE, 6) AS core_pct FROM core""",
    SURPRISE_SQL,
)
def core_extremes(spark, sf_dir):
    s = interaction.surprise(order_residuals(spark, sf_dir)).select("zone_id", "surprise")
    core = s.join(views.zones(spark, sf_dir).where(F.col("service_zone").isin("Yellow Zone", "Airports")).select("zone_id"), "zone_id", "left_semi")
    place = (F.row_number().over(Window.orderBy("surprise", "zone_id")) - 1) / F.count(F.lit(1)).over(Window.partitionBy())
    out = core.select("zone_id", F.round("surprise", 4).alias("surprise"), F.round(place, 6).alias("core_pct"))
    return out


# --- iterative centralities


def _pagerank_sql(rounds: int) -> str:
    out = """sh AS (SELECT o, d, trips / (sum(trips) OVER (PARTITION BY o))::DOUBLE AS share FROM p), ids AS (SELECT o AS id FROM p UNION SELECT d FROM p),
r0 AS (SELECT id, 1.0::DOUBLE / count(*) OVER () AS rank FROM ids)"""
    for k in range(1, rounds + 1):
        out += f""", r{k} AS (SELECT id, 0.15::DOUBLE / (SELECT count(*) FROM ids) + 0.85::DOUBLE * (coalesce(flow, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE id NOT IN (SELECT o FROM p)) / (SELECT count(*) FROM ids)) AS rank
  FROM ids LEFT JOIN (SELECT d AS id, sum(rank * share) AS flow FROM sh JOIN r{k - 1} ON id = o GROUP BY d) USING (id))"""
    return out


@query("SELECT id AS zone_id, round(rank, 8) AS rank FROM r8", f"{SPARSE_SQL}, {_pagerank_sql(8)}")
def pagerank(spark, sf_dir):
    return rounded(centrality.pagerank(views.sparse_edges(spark, sf_dir), 8), 8)


def _hits_sql(rounds: int) -> str:
    out = "ids AS (SELECT o AS id FROM p UNION SELECT d FROM p), h0 AS (SELECT id, 1.0::DOUBLE AS h FROM ids)"
    for k in range(1, rounds + 1):
        out += f""", a{k} AS (SELECT id, x / sqrt(sum(x * x) OVER ()) AS a FROM (SELECT d AS id, sum(h * trips) AS x FROM p JOIN h{k - 1} ON id = o GROUP BY d)),
h{k} AS (SELECT id, x / sqrt(sum(x * x) OVER ()) AS h FROM (SELECT o AS id, sum(a * trips) AS x FROM p JOIN a{k} ON id = d GROUP BY o))"""
    return out


@query("SELECT id AS zone_id, round(coalesce(h, 0), 6) AS hub, round(coalesce(a, 0), 6) AS authority FROM ids LEFT JOIN h6 USING (id) LEFT JOIN a6 USING (id)", f"{SPARSE_SQL}, {_hits_sql(6)}")
def hits(spark, sf_dir):
    return rounded(centrality.hits(views.sparse_edges(spark, sf_dir), 6))


def _eigen_sql(rounds: int) -> str:
    out = "ids AS (SELECT o AS id FROM p UNION SELECT d FROM p), x0 AS (SELECT id, 1.0::DOUBLE AS x FROM ids)"
    for k in range(1, rounds + 1):
        out += f", x{k} AS (SELECT id, y / sqrt(sum(y * y) OVER ()) AS x FROM (SELECT ids.id, coalesce(y, 0) AS y FROM ids LEFT JOIN (SELECT d AS id, sum(x * trips) AS y FROM p JOIN x{k - 1} ON id = o GROUP BY d) USING (id)))"
    return out


@query("SELECT id AS zone_id, round(x, 6) AS eigenvector FROM x6", f"{SPARSE_SQL}, {_eigen_sql(6)}")
def eigenvector(spark, sf_dir):
    return rounded(centrality.eigenvector(views.sparse_edges(spark, sf_dir), 6))


def _label_sql(rounds: int) -> str:
    out = "wy AS (SELECT o AS a, d AS b FROM p UNION SELECT d, o FROM p), l0 AS (SELECT DISTINCT a AS id, a AS label FROM wy)"
    for k in range(1, rounds + 1):
        out += f", l{k} AS (SELECT id, label FROM (SELECT a AS id, label, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, label) AS n FROM wy JOIN l{k - 1} ON id = b GROUP BY a, label) WHERE n = 1)"
    return out


@query("SELECT id AS zone_id, label AS community FROM l4", f"{SPARSE_SQL}, {_label_sql(4)}")
def label_propagation(spark, sf_dir):
    return centrality.label_propagation(views.sparse_edges(spark, sf_dir), 4)


@query(
    "SELECT id AS zone_id, min(low) AS component FROM reach GROUP BY id",
    f"RECURSIVE {SPARSE_SQL.replace('sparse AS', 'sparse AS')}, wy AS (SELECT o AS a, d AS b FROM p UNION SELECT d, o FROM p), reach AS (SELECT a AS id, a AS low FROM wy UNION SELECT b, low FROM reach JOIN wy ON a = id WHERE low < b)",
)
def weak_components(spark, sf_dir):
    return centrality.weak_components(views.sparse_edges(spark, sf_dir))


def _core_sql(rounds: int) -> str:
    """Core numbers by so many refinements of the degrees."""
    out = "wk AS (SELECT o AS a, d AS b FROM p UNION SELECT d, o FROM p), k0 AS MATERIALIZED (SELECT a, count(*) AS k FROM wk GROUP BY a)"
    for i in range(1, rounds + 1):
        out += f", k{i} AS MATERIALIZED (SELECT a, least(max(k0_), max(least(i, kb))) AS k FROM (SELECT w.a, y.k AS k0_, x.k AS kb, row_number() OVER (PARTITION BY w.a ORDER BY x.k DESC) AS i FROM wk w JOIN k{i - 1} x ON x.a = w.b JOIN k{i - 1} y ON y.a = w.a) GROUP BY a)"
    return out


@query("SELECT a AS zone_id, CAST(k AS INTEGER) AS core FROM k25", f"{SPARSE_SQL}, {_core_sql(25)}")
def kcore(spark, sf_dir):
    return centrality.core_numbers(views.sparse_edges(spark, sf_dir))


@query("SELECT id AS zone_id, round(rank, 8) AS rank FROM r40", f"{SPARSE_SQL}, {_pagerank_sql(40)}")
def pagerank_settled(spark, sf_dir):
    return rounded(centrality.settled_pagerank(views.sparse_edges(spark, sf_dir), close=1e-13), 8)


@query("SELECT id AS zone_id, round(coalesce(h, 0), 6) AS hub, round(coalesce(a, 0), 6) AS authority FROM ids LEFT JOIN h60 USING (id) LEFT JOIN a60 USING (id)", f"{SPARSE_SQL}, {_hits_sql(60)}")
def hits_settled(spark, sf_dir):
    return rounded(centrality.settled_hits(views.sparse_edges(spark, sf_dir)))


@query("SELECT id AS zone_id, round(x, 6) AS eigenvector FROM x60", f"{SPARSE_SQL}, {_eigen_sql(60)}")
def eigenvector_settled(spark, sf_dir):
    return rounded(centrality.settled_eigenvector(views.sparse_edges(spark, sf_dir)))


@query(
    """SELECT (SELECT round(sum(least(a.trips, coalesce(b.trips, 0))) / sum(a.trips)::DOUBLE, 6) FROM p a LEFT JOIN p b ON a.o = b.d AND a.d = b.o) AS weighted_reciprocity,
  (SELECT round((r - density) / nullif(1 - density, 0), 6) FROM (SELECT m / links::DOUBLE AS r, links / (n * (n - 1))::DOUBLE AS density FROM (
    SELECT count(*) AS links, count(b.o) AS m, (SELECT count(*) FROM (SELECT o FROM p UNION SELECT d FROM p)) AS n FROM p a LEFT JOIN p b ON a.o = b.d AND a.d = b.o))) AS rho,
  (SELECT round(avg(x), 6) FROM im) AS mean_imbalance, (SELECT round(median(x), 6) FROM im) AS median_imbalance,
  (SELECT CASE WHEN max(ko) > min(ko) AND max(kd) > min(kd) THEN round(corr(ko, kd), 6) END FROM (SELECT count(*) OVER (PARTITION BY o) AS ko, count(*) OVER (PARTITION BY d) AS kd FROM p)) AS assortativity,
  (SELECT CAST(max(k) AS INTEGER) FROM k25) AS max_kcore""",
    f"{EDGES_SQL}, im AS (SELECT abs(a.trips - b.trips) / (a.trips + b.trips)::DOUBLE AS x FROM p a JOIN p b ON a.o = b.d AND a.d = b.o WHERE a.o < a.d), {_core_sql(25)}",
)
def structure_bundle(spark, sf_dir):
    from odflux.operators import tables

    return rounded(tables.structure_bundle(order_edges(spark, sf_dir)))


# --- partitions given by attributes


@query(
    "SELECT round(sum(inside / m - pow(degree / (2 * m), 2)), 6) AS modularity FROM (SELECT g, sum(inside) AS inside, sum(degree) AS degree, max(m) AS m FROM gd GROUP BY g)",
    f"{EDGES_SQL}, {UNDIRECTED_SQL}, {views.ZONES}, gd AS (SELECT a.borough AS g, CASE WHEN a.borough = b.borough THEN trips ELSE 0 END::DOUBLE AS inside, trips::DOUBLE AS degree, (SELECT sum(trips) FROM un)::DOUBLE AS m FROM un JOIN zones a ON a.zone_id = u JOIN zones b ON b.zone_id = v "
    "UNION ALL SELECT b.borough, 0, trips, (SELECT sum(trips) FROM un) FROM un JOIN zones a ON a.zone_id = u JOIN zones b ON b.zone_id = v)",
)
def modularity_by_region(spark, sf_dir):
    part = views.zones(spark, sf_dir).select("zone_id", F.col("borough").alias("community"))
    return rounded(evolution.modularity(structure.undirected(order_edges(spark, sf_dir)), part))


@query(
    "SELECT a.borough AS from_group, b.borough AS to_group, sum(trips)::BIGINT AS trips, round(sum(sum(CASE WHEN a.borough = b.borough THEN trips ELSE 0 END)) OVER () / (sum(sum(trips)) OVER ())::DOUBLE, 6) AS within_share FROM p JOIN zones a ON a.zone_id = o JOIN zones b ON b.zone_id = d GROUP BY ALL",
    f"{EDGES_SQL}, {views.ZONES}",
)
def flow_matrix_by_region(spark, sf_dir):
    part = views.zones(spark, sf_dir).select("zone_id", F.col("borough").alias("community"))
    return rounded(evolution.flow_matrix(order_edges(spark, sf_dir), part))


@query(
    """SELECT round((idx - ex) / nullif((sa + sb) / 2 - ex, 0), 6) AS ari FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct)::DOUBLE AS idx, sa, sb, sa * sb / (t * (t - 1) / 2) AS ex FROM (
  SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ct GROUP BY a))::DOUBLE AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ct GROUP BY b))::DOUBLE AS sb, (SELECT sum(n) FROM ct)::DOUBLE AS t))""",
    f"{views.ZONES}, ct AS (SELECT borough AS a, service_zone AS b, count(*) AS n FROM zones GROUP BY ALL)",
)
def ari_region_vs_segment(spark, sf_dir):
    z = views.zones(spark, sf_dir)
    return rounded(evolution.adjusted_rand(z.select("zone_id", F.col("borough").alias("a"), F.col("service_zone").alias("b"))))


# --- years


@query(
    """SELECT yr, n_edges, coalesce(n_nodes, 0)::BIGINT AS n_nodes, total_trips, self_trips, round(mean_dist, 6) AS mean_dist, round(density, 6) AS density, round(weighted_reciprocity, 6) AS weighted_reciprocity,
  round((r - density) / nullif(1 - density, 0), 6) AS reciprocity_rho, round(degree_assortativity, 6) AS degree_assortativity
FROM (SELECT *, n_edges / nullif(n_nodes * (n_nodes - 1), 0)::DOUBLE AS density FROM ysum LEFT JOIN ynodes USING (yr)) LEFT JOIN yrec USING (yr)""",
    f"""{CLEAN_SQL}, ye AS (SELECT yr, o, d, count(*) AS trips, sum(dist) AS sum_dist FROM clean GROUP BY ALL), yp AS (SELECT *, count(*) OVER (PARTITION BY yr, o) AS ko, count(*) OVER (PARTITION BY yr, d) AS kd FROM ye WHERE o <> d),
ysum AS (SELECT yr, count(*) FILTER (o <> d) AS n_edges, coalesce(sum(trips) FILTER (o <> d), 0)::BIGINT AS total_trips, coalesce(sum(trips) FILTER (o = d), 0)::BIGINT AS self_trips, sum(sum_dist) FILTER (o <> d) / sum(trips) FILTER (o <> d) AS mean_dist FROM ye GROUP BY yr),
ynodes AS (SELECT yr, count(*) AS n_nodes FROM (SELECT yr, o FROM yp UNION SELECT yr, d FROM yp) GROUP BY yr),
yrec AS (SELECT a.yr, sum(least(a.trips, coalesce(b.trips, 0))) / sum(a.trips)::DOUBLE AS weighted_reciprocity, count(b.o) / count(*)::DOUBLE AS r, corr(a.ko, a.kd) AS degree_assortativity FROM yp a LEFT JOIN yp b ON a.yr = b.yr AND a.o = b.d AND a.d = b.o GROUP BY a.yr)""",
)
def year_panel(spark, sf_dir):
    return rounded(evolution.panel(A.edges(clean_orders(spark, sf_dir), "yr")))


VOLUME_SQL = f"{CLEAN_SQL}, yv AS (SELECT yr, count(*) AS trips, sum(fare) AS sum_fare FROM clean WHERE o <> d GROUP BY yr)"


def _volumes(spark, sf_dir):
    return clean_orders(spark, sf_dir).where("o <> d").groupBy("yr").agg(F.count(F.lit(1)).alias("trips"), F.sum("fare").alias("sum_fare"))


@query("SELECT yr, trips, lag(trips) OVER (ORDER BY yr) AS previous, round((trips - lag(trips) OVER (ORDER BY yr)) * 100.0::DOUBLE / lag(trips) OVER (ORDER BY yr), 6) AS change_pct FROM yv", VOLUME_SQL)
def yoy_change(spark, sf_dir):
    return rounded(evolution.yearly_change(_volumes(spark, sf_dir), "trips"))


@query("SELECT round(avg(trips), 6) AS mean, min(trips) AS min, max(trips) AS max, round(stddev_samp(trips) / avg(abs(trips)), 6) AS cv FROM yv", VOLUME_SQL)
def metric_cv(spark, sf_dir):
    return rounded(evolution.variation(_volumes(spark, sf_dir), "trips"))


@query("SELECT yr, trips, round(trips * 100.0::DOUBLE / max(CASE WHEN yr = 1998 THEN trips END) OVER (), 6) AS index FROM yv", VOLUME_SQL)
def base_year_index(spark, sf_dir):
    return rounded(evolution.base_index(_volumes(spark, sf_dir), "trips", 1998))


@query(
    """SELECT yr, d AS zone_id, inward, rank, round(inward / (sum(inward) OVER (PARTITION BY yr))::DOUBLE, 6) AS share FROM (SELECT yr, d, count(*) AS inward, CAST(row_number() OVER (PARTITION BY yr ORDER BY count(*) DESC, d) AS INTEGER) AS rank FROM clean WHERE o <> d GROUP BY yr, d) QUALIFY rank <= 5""",
    CLEAN_SQL,
)
def hub_share_by_year(spark, sf_dir):
    return rounded(evolution.hub_shares(A.edges(clean_orders(spark, sf_dir), "yr"), 5))


@query(
    """SELECT yr, o, d, trips, rank FROM (SELECT yr, o, d, count(*) AS trips, CAST(row_number() OVER (PARTITION BY yr ORDER BY count(*) DESC, o, d) AS INTEGER) AS rank FROM clean WHERE o <> d GROUP BY yr, o, d) WHERE rank <= 400""",
    CLEAN_SQL,
)
def top_edges_per_year(spark, sf_dir):
    return evolution.top_edges(A.edges(clean_orders(spark, sf_dir), "yr"), 400)


@query(
    """SELECT zone_id, '{"type":"Feature","zone":' || to_json(zone) || ',"years":{' || coalesce(string_agg('"' || yr || '":{"in":' || n || '}', ',' ORDER BY yr), '') || '}}' AS feature
FROM zones LEFT JOIN (SELECT yr, d, count(*) AS n FROM clean WHERE o <> d GROUP BY yr, d) ON d = zone_id GROUP BY zone_id, zone""",
    f"{CLEAN_SQL}, {views.ZONES}",
)
def zone_year_json(spark, sf_dir):
    yearly = clean_orders(spark, sf_dir).where("o <> d").groupBy(F.col("d").alias("zone_id"), "yr").agg(F.count(F.lit(1)).alias("in"))
    entries = yearly.groupBy("zone_id").agg(F.sort_array(F.collect_list(F.struct(F.col("yr").cast("string").alias("key"), F.struct("in").alias("value")))).alias("e"))
    joined = views.zones(spark, sf_dir).join(entries, "zone_id", "left")
    years = F.coalesce(F.to_json(F.map_from_entries("e")), F.lit("{}"))
    return joined.select("zone_id", F.concat(F.lit('{"type":"Feature","zone":'), F.to_json(F.array("zone")).substr(F.lit(2), F.length(F.to_json(F.array("zone"))) - 2), F.lit(',"years":'), years, F.lit("}")).alias("feature"))


SPEARMAN_SQL = f"""{NODES_SQL}, rk AS (SELECT rank() OVER (ORDER BY out_strength) + (count(*) OVER (PARTITION BY out_strength) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY in_strength) + (count(*) OVER (PARTITION BY in_strength) - 1) / 2.0::DOUBLE AS b,
  rank() OVER (ORDER BY in_degree) + (count(*) OVER (PARTITION BY in_degree) - 1) / 2.0::DOUBLE AS c FROM nodes)"""


@query(
    """SELECT 'in_degree' AS x, 'in_strength' AS y, round(corr(c, b), 6) AS rho FROM rk UNION ALL SELECT 'in_degree', 'out_strength', round(corr(c, a), 6) FROM rk UNION ALL SELECT 'in_strength', 'out_strength', round(corr(b, a), 6) FROM rk""",
    SPEARMAN_SQL,
)
def spearman_matrix(spark, sf_dir):
    return rounded(evolution.spearman(order_nodes(spark, sf_dir), ["in_degree", "in_strength", "out_strength"]))


# --- older forms


@query(
    """SELECT o, d, yr, mo, hr, count(*) AS trips, round(sum(dist) + 1e-7, 4) AS sum_dist, round(sum(dur) + 1e-7, 4) AS sum_dur, round(sum(fare) + 1e-7, 4) AS sum_fare, round(sum(total) + 1e-7, 4) AS sum_total
FROM clean GROUP BY GROUPING SETS ((o, d, yr), (o, d, yr, mo), (o, d, yr, mo, hr))""",
    CLEAN_SQL,
)
def legacy_grouping_sets(spark, sf_dir):
    return rounded(off_ties(A.grouping_levels(clean_orders(spark, sf_dir))), 4)


@query("SELECT zone_id, zone FROM zones WHERE cx_ft BETWEEN 10000 AND 90000 AND cy_ft BETWEEN 5000 AND 100000", views.ZONES)
def legacy_bbox_filter(spark, sf_dir):
    return spatial.in_box(views.zones(spark, sf_dir), 10000, 90000, 5000, 100000).select("zone_id", "zone")


@query(
    f"""SELECT CASE WHEN trips >= {THRESHOLD} THEN 'frequent' ELSE 'infrequent' END AS class, count(*) AS edges, sum(trips)::BIGINT AS trips FROM p GROUP BY ALL""",
    EDGES_SQL,
)
def legacy_frequency_split(spark, sf_dir):
    kind = F.when(F.col("trips") >= THRESHOLD, "frequent").otherwise("infrequent")
    return A.without_loops(order_edges(spark, sf_dir)).groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("edges"), F.sum("trips").alias("trips"))


@query(
    """SELECT user_id, ts, value, last_value(CASE WHEN value >= 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS big_filled FROM events"""
)
def forward_fill(spark, sf_dir):
    events = views.read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value").withColumn("big", F.when(F.col("value") >= 50, F.col("value")))
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("big_filled", F.last("big", ignorenulls=True).over(upto)).select("user_id", "ts", "value", "big_filled")


@query("SELECT wd, mo, round(avg(n), 6) AS mean_trips FROM (SELECT wd, mo, o, count(*) AS n FROM clean GROUP BY ALL) GROUP BY wd, mo", CLEAN_SQL)
def legacy_mean_by_month_weekday(spark, sf_dir):
    cells = clean_orders(spark, sf_dir).groupBy("wd", "mo", "o").agg(F.count(F.lit(1)).alias("trips"))
    return rounded(temporal.mean_by(cells, "wd", "mo"))


@query("SELECT CASE WHEN hr < 6 THEN '00-06' WHEN hr < 12 THEN '06-12' WHEN hr < 18 THEN '12-18' ELSE '18-24' END AS part, count(*) AS trips FROM ev GROUP BY ALL", views.EVENT_TRIPS)
def legacy_quarter_day(spark, sf_dir):
    return views.event_trips(spark, sf_dir).groupBy(quarter_day(F.col("hr")).alias("part")).agg(F.count(F.lit(1)).alias("trips"))


@query("SELECT zone_id, '36' || CASE borough WHEN 'ASIA' THEN '061' ELSE '081' END || lpad(CAST(zone_id * 100 AS VARCHAR), 6, '0') AS geoid FROM zones", views.ZONES)
def tract_identifiers(spark, sf_dir):
    county = F.when(F.col("borough") == "ASIA", "061").otherwise("081")
    return views.zones(spark, sf_dir).select("zone_id", geoid("36", county, F.col("zone_id") * 100).alias("geoid"))


@query("SELECT count(DISTINCT printf('%.3f,%.3f', cx_ft / 100000, cy_ft / 100000)) AS keys FROM zones WHERE cx_ft IS NOT NULL", views.ZONES)
def legacy_coordinate_keys(spark, sf_dir):
    z = views.zones(spark, sf_dir).where("cx_ft is not null")
    return z.select(coordinate_key(F.col("cx_ft") / 100000, F.col("cy_ft") / 100000).alias("k")).agg(F.count_distinct("k").alias("keys"))


@query(
    """SELECT service_zone, sum(CASE WHEN yr = 1995 THEN n ELSE 0 END)::BIGINT AS y1995, sum(CASE WHEN yr = 1996 THEN n ELSE 0 END)::BIGINT AS y1996, sum(CASE WHEN yr = 1997 THEN n ELSE 0 END)::BIGINT AS y1997
FROM (SELECT o, yr, count(*) AS n FROM clean GROUP BY ALL) JOIN zones ON zone_id = o GROUP BY service_zone""",
    f"{CLEAN_SQL}, {views.ZONES}",
)
def pivot_years(spark, sf_dir):
    joined = clean_orders(spark, sf_dir).groupBy("o", "yr").agg(F.count(F.lit(1)).alias("n")).join(views.zones(spark, sf_dir).select("zone_id", "service_zone"), F.col("o") == F.col("zone_id"))
    wide = joined.groupBy("service_zone").pivot("yr", [1995, 1996, 1997]).agg(F.sum("n")).na.fill(0)
    return wide.select("service_zone", *[F.col(str(y)).alias(f"y{y}") for y in (1995, 1996, 1997)])


@query("SELECT (SELECT count(*) FROM (SELECT o FROM p UNION SELECT d FROM p)) AS united, (SELECT count(*) FROM (SELECT o FROM p INTERSECT SELECT d FROM p)) AS shared, (SELECT count(*) FROM (SELECT o FROM p EXCEPT SELECT d FROM p)) AS origins_only", SPARSE_SQL)
def endpoint_sets(spark, sf_dir):
    e = A.without_loops(views.sparse_edges(spark, sf_dir))
    o, d = e.select(F.col("o").alias("id")), e.select(F.col("d").alias("id"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(o.union(d).distinct(), "united").join(one(o.intersect(d), "shared")).join(one(o.distinct().subtract(d), "origins_only"))
