"""Queries of strong components, shortest paths, partitions compared, models, densities, the monthly store and the streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from odflux.operators import aggregates as A
from odflux.operators import density, evolution, interaction, panel, reach, spatial
from odflux.operators.iterate import Iterates
from odflux.plans.catalog import CLEAN_SQL, DAYPART_SQL, EDGES_SQL, FURNESS_SQL, MILES_SQL, ORACLES, SPARSE_SQL, clean_orders, off_ties, order_edges, order_furness, query, rounded
from odflux.sources import store, views
from odflux.streaming import hourly

SEEDS, EVERY = 20, 5


def _main_flows(k: int) -> str:
    return f"{SPARSE_SQL}, top AS (SELECT o, d, trips FROM p QUALIFY row_number() OVER (PARTITION BY o ORDER BY trips DESC, d) <= {k})"


def main_flows(spark, sf_dir, k: int):
    """Each origin's k strongest edges: a directed graph with many components, at any size of the tables."""
    order = Window.partitionBy("o").orderBy(F.desc("trips"), "d")
    return A.without_loops(views.sparse_edges(spark, sf_dir)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


#: Coordinates of the classes of the sparse graph, in miles.
PLACES_SQL = "places AS (SELECT id AS zone_id, CAST(id * 7919 % 211 AS DOUBLE) * 5280 AS cx_ft, CAST(id * 104729 % 197 AS DOUBLE) * 5280 AS cy_ft FROM (SELECT o AS id FROM top UNION SELECT d FROM top))"


def places(edges):
    ids = A.endpoints(edges)
    at = lambda a, b: (F.col("id") * a % b).cast("double") * 5280
    return ids.select(F.col("id").alias("zone_id"), at(7919, 211).alias("cx_ft"), at(104729, 197).alias("cy_ft"))


def _doubled(edges: str, rounds: int, name: str = "m") -> str:
    """Shortest lengths over up to 2**rounds edges of ``edges`` (k, o, d, len), each table joined with itself."""
    start = f"{name}0 AS MATERIALIZED (SELECT k, o, d, min(len) AS len FROM (SELECT k, o, d, len FROM {edges} UNION ALL SELECT k, o, o, 0 FROM {edges} UNION ALL SELECT k, d, d, 0 FROM {edges}) GROUP BY ALL)"
    more = [f"{name}{i} AS MATERIALIZED (SELECT a.k, a.o, b.d, min(a.len + b.len) AS len FROM {name}{i - 1} a JOIN {name}{i - 1} b ON a.k = b.k AND a.d = b.o GROUP BY ALL)" for i in range(1, rounds + 1)]
    return ", ".join([start, *more])


# --- strong components


@query(
    "SELECT r.a AS zone_id, min(r.b) AS component FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a GROUP BY r.a",
    f"RECURSIVE {_main_flows(2)}, reach(a, b) AS (SELECT o, o FROM top UNION SELECT d, d FROM top UNION SELECT a, d FROM reach JOIN top ON b = o)",
)
def strong_components(spark, sf_dir):
    return reach.strong_components(main_flows(spark, sf_dir, 2)).withColumnRenamed("id", "zone_id")


HASH_SQL = "(((seed + 42) * 48271 + 11) % 2147483647 + id) * 48271 + 11"
CURVES_SQL = f"""RECURSIVE {CLEAN_SQL}, ye AS (SELECT DISTINCT yr, o, d FROM clean WHERE o <> d AND mo <= 2), yn AS (SELECT yr, o AS id FROM ye UNION SELECT yr, d FROM ye),
ord AS (SELECT yr, seed, id, row_number() OVER (PARTITION BY yr, seed ORDER BY ({HASH_SQL}) % 2147483647, id) - 1 AS place, count(*) OVER (PARTITION BY yr, seed) AS n FROM yn, (SELECT range AS seed FROM range({SEEDS}))),
alive AS MATERIALIZED (SELECT yr, seed, gone, id, n FROM (SELECT *, unnest(range(0, n, {EVERY})) AS gone FROM ord) WHERE place >= gone),
links AS MATERIALIZED (SELECT a.yr, a.seed, a.gone, e.o, e.d FROM ye e JOIN alive a ON a.yr = e.yr AND a.id = e.o JOIN alive b ON b.yr = a.yr AND b.seed = a.seed AND b.gone = a.gone AND b.id = e.d),
reach AS (SELECT yr, seed, gone, id AS a, id AS b FROM alive UNION SELECT r.yr, r.seed, r.gone, r.a, l.d FROM reach r JOIN links l ON l.yr = r.yr AND l.seed = r.seed AND l.gone = r.gone AND l.o = r.b),
curve AS (SELECT yr, seed, gone, max(size) AS largest FROM (
  SELECT r.yr, r.seed, r.gone, r.a, count(*) AS size FROM reach r JOIN reach s ON r.yr = s.yr AND r.seed = s.seed AND r.gone = s.gone AND r.a = s.b AND r.b = s.a GROUP BY ALL) GROUP BY ALL)"""


def yearly_links(spark, sf_dir):
    """Edges of the first two months of each year, when not every pair of zones has trips."""
    return A.edges(clean_orders(spark, sf_dir).where("mo <= 2"), "yr")


@query("SELECT yr, CAST(seed AS INTEGER) AS seed, CAST(gone AS INTEGER) AS gone, largest, n FROM curve JOIN (SELECT DISTINCT yr, seed, n FROM ord) USING (yr, seed)", CURVES_SQL)
def scc_failure_curves(spark, sf_dir):
    return reach.failure_curves(yearly_links(spark, sf_dir), SEEDS, EVERY, "yr")


@query("SELECT yr, round(avg(r), 6) AS schneider_r FROM (SELECT yr, seed, avg(largest / n::DOUBLE) AS r FROM curve JOIN (SELECT DISTINCT yr, seed, n FROM ord) USING (yr, seed) GROUP BY ALL) GROUP BY yr", CURVES_SQL)
def schneider_scc(spark, sf_dir):
    return rounded(reach.schneider_random(yearly_links(spark, sf_dir), SEEDS, EVERY, "yr"))


# --- shortest paths

LENGTHS_SQL = f"""{_main_flows(3)}, {PLACES_SQL}, long AS (
  SELECT 'distance' AS k, o, d, {MILES_SQL} AS len FROM top JOIN places a ON a.zone_id = o JOIN places b ON b.zone_id = d UNION ALL SELECT 'cost', o, d, 1 / trips::DOUBLE FROM top UNION ALL SELECT 'hops', o, d, 1.0::DOUBLE FROM top), {_doubled('long', 5)}"""


def main_lengths(spark, sf_dir):
    """Edges of the main flows by miles, by 1 / trips and by hops: (measure, o, d, length)."""
    top = main_flows(spark, sf_dir, 3)
    far = interaction.with_distance(top, places(top))
    return far.select("o", "d", F.explode(F.map_from_arrays(F.array(F.lit("distance"), F.lit("cost"), F.lit("hops")), F.array("miles", 1 / F.col("trips"), F.lit(1.0)))).alias("measure", "length"))


@query("SELECT k AS measure, (SELECT count(*) FROM places) AS n_nodes, round(sum(1 / len) / ((SELECT count(*) FROM places) * ((SELECT count(*) FROM places) - 1)), 6) AS efficiency FROM m5 WHERE o <> d AND len > 0 GROUP BY k", LENGTHS_SQL)
def path_efficiencies(spark, sf_dir):
    lengths = main_lengths(spark, sf_dir)
    nodes = lengths.select("measure", F.explode(F.array("o", "d")).alias("id"))
    return rounded(reach.path_efficiency(reach.shortest_paths(lengths, "measure"), nodes, "measure"))


@query(
    f"""SELECT round(e, 6) AS efficiency, round(i, 6) AS ideal_efficiency, round(e / i, 6) AS normalised FROM (SELECT
  (SELECT sum(1 / len) FROM m5 WHERE k = 'distance' AND o <> d AND len > 0) / (SELECT count(*) * (count(*) - 1) FROM places) AS e, (SELECT avg(1 / m) FROM (SELECT {MILES_SQL} AS m FROM places a JOIN places b ON a.zone_id <> b.zone_id) WHERE m > 0) AS i)""",
    LENGTHS_SQL,
)
def distance_efficiency(spark, sf_dir):
    top = main_flows(spark, sf_dir, 3)
    lengths = main_lengths(spark, sf_dir).where("measure = 'distance'").drop("measure")
    found = reach.path_efficiency(reach.shortest_paths(lengths), A.endpoints(top)).drop("n_nodes")
    return rounded(found.join(interaction.ideal_efficiency(places(top)).drop("pairs")).withColumn("normalised", F.try_divide("efficiency", "ideal_efficiency")))


DETOURS_SQL = f"{LENGTHS_SQL}, det AS (SELECT m.o, m.d, {MILES_SQL} AS straight, len AS network, len / ({MILES_SQL}) AS circuity FROM m5 m JOIN places a ON a.zone_id = o JOIN places b ON b.zone_id = d WHERE k = 'distance' AND o <> d AND len > 0 AND {MILES_SQL} > 0)"


def main_detours(spark, sf_dir):
    top = main_flows(spark, sf_dir, 3)
    paths = reach.shortest_paths(main_lengths(spark, sf_dir).where("measure = 'distance'").drop("measure"))
    return reach.detours(paths, interaction.with_distance(paths.select("o", "d"), places(top)))


@query(
    "SELECT count(*) AS n_pairs, round(avg(circuity), 6) AS mean, round(quantile_cont(circuity, 0.5), 6) AS median, round(quantile_cont(circuity, 0.9), 6) AS p90, round(max(circuity), 6) AS max, (SELECT round(avg(s), 6) FROM (SELECT avg(straight / network) AS s FROM det GROUP BY o)) AS mean_straightness FROM det",
    DETOURS_SQL,
)
def circuity_summary(spark, sf_dir):
    return rounded(reach.detour_summary(main_detours(spark, sf_dir)))


@query("SELECT o, d, round(straight, 6) AS straight, round(network, 6) AS network, round(circuity, 6) AS circuity FROM det WHERE straight >= 0.5 ORDER BY round(circuity, 9) DESC, o, d LIMIT 8", DETOURS_SQL)
def circuity_corridors(spark, sf_dir):
    return rounded(reach.corridors(main_detours(spark, sf_dir)))


@query("SELECT o AS zone_id, round(avg(straight / network), 6) AS straightness FROM det GROUP BY o", DETOURS_SQL)
def straightness(spark, sf_dir):
    return rounded(reach.straightness(main_detours(spark, sf_dir)))


@query(
    f"SELECT m.o, m.d, round({MILES_SQL}, 6) AS straight, round(len, 6) AS network, round(len / ({MILES_SQL}), 6) AS circuity FROM m4 m JOIN zones a ON a.zone_id = m.o JOIN zones b ON b.zone_id = m.d WHERE m.o <> m.d AND len > 0 AND {MILES_SQL} >= 0.5",
    f"{EDGES_SQL}, {views.ZONES}, long AS (SELECT 1 AS k, o, d, {MILES_SQL} AS len FROM p JOIN zones a ON a.zone_id = o JOIN zones b ON b.zone_id = d WHERE {MILES_SQL} IS NOT NULL), {_doubled('long', 4)}",
)
def circuity(spark, sf_dir):
    edges, zones = order_edges(spark, sf_dir), views.zones(spark, sf_dir)
    paths = reach.shortest_paths(interaction.with_distance(A.without_loops(edges), zones).where("miles is not null").select("o", "d", F.col("miles").alias("length")))
    pairs = reach.detours(paths, interaction.with_distance(paths.select("o", "d"), zones))
    return rounded(pairs.where("straight >= 0.5"))


# --- partitions compared


def _mutual(table: str, key: str) -> str:
    """Adjusted Rand index and adjusted mutual information of ``table`` (key, a, b), one row an item."""
    return f"""ct AS (SELECT {key}, a, b, count(*) AS n FROM {table} GROUP BY ALL), ra AS (SELECT {key}, a, sum(n) AS n FROM ct GROUP BY ALL), rb AS (SELECT {key}, b, sum(n) AS n FROM ct GROUP BY ALL), tt AS (SELECT {key}, sum(n) AS t FROM ct GROUP BY ALL),
mi AS (SELECT {key}, sum(ct.n / t * ln(t * ct.n / (ra.n * rb.n))) AS mi FROM ct JOIN ra USING ({key}, a) JOIN rb USING ({key}, b) JOIN tt USING ({key}) GROUP BY {key}),
hs AS (SELECT {key}, (SELECT -sum(n / t * ln(n / t)) FROM ra x WHERE x.{key} = tt.{key}) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM rb x WHERE x.{key} = tt.{key}) AS hb FROM tt),
em AS (SELECT {key}, sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS emi
  FROM (SELECT {key}, t::DOUBLE AS t, ra.n::DOUBLE AS x, rb.n::DOUBLE AS y, unnest(range(greatest(1, ra.n + rb.n - t)::BIGINT, least(ra.n, rb.n)::BIGINT + 1))::DOUBLE AS k FROM ra JOIN rb USING ({key}) JOIN tt USING ({key})) GROUP BY {key}),
ri AS (SELECT {key}, t, (SELECT sum(n * (n - 1) / 2) FROM ct x WHERE x.{key} = tt.{key})::DOUBLE AS idx, (SELECT sum(n * (n - 1) / 2) FROM ra x WHERE x.{key} = tt.{key})::DOUBLE AS sa, (SELECT sum(n * (n - 1) / 2) FROM rb x WHERE x.{key} = tt.{key})::DOUBLE AS sb FROM tt),
sc AS (SELECT {key}, t::BIGINT AS items, CASE WHEN t >= 2 THEN (idx - sa * sb / (t * (t - 1) / 2)) / nullif((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2), 0) END AS ari,
  CASE WHEN t >= 2 THEN CASE WHEN ha = 0 AND hb = 0 THEN 1 WHEN abs((ha + hb) / 2 - emi) > 1e-12 THEN (mi - emi) / ((ha + hb) / 2 - emi) END END AS ami FROM ri JOIN mi USING ({key}) JOIN hs USING ({key}) JOIN em USING ({key}))"""


MAIN_REGION_SQL = f"""{CLEAN_SQL}, {views.ZONES}, yf AS (SELECT yr, o AS zone_id, borough AS region, count(*) AS trips FROM clean JOIN zones ON zones.zone_id = d WHERE o <> d GROUP BY ALL),
part AS (SELECT yr, zone_id, region FROM yf QUALIFY row_number() OVER (PARTITION BY yr, zone_id ORDER BY trips DESC, region) = 1)"""


def main_regions(spark, sf_dir):
    """(yr, zone_id, community): the borough that takes most of a zone's trips of a year."""
    zones = views.zones(spark, sf_dir).select(F.col("zone_id").alias("d"), F.col("borough").alias("community"))
    flows = A.edges(clean_orders(spark, sf_dir), "yr").where("o <> d").join(zones, "d").groupBy("yr", F.col("o").alias("zone_id"), "community").agg(F.sum("trips").alias("trips"))
    return flows.groupBy("yr", "zone_id").agg(F.min_by("community", F.struct(-F.col("trips"), F.col("community"))).alias("community"))


@query("SELECT attribute, items, round(ari, 6) AS ari, round(ami, 6) AS ami FROM sc", f"{MAIN_REGION_SQL}, pr AS (SELECT 'borough' AS attribute, region AS a, borough AS b FROM part JOIN zones USING (zone_id) WHERE yr = 1996 UNION ALL SELECT 'service_zone', region, service_zone FROM part JOIN zones USING (zone_id) WHERE yr = 1996), {_mutual('pr', 'attribute')}")
def partition_against_attributes(spark, sf_dir):
    part = main_regions(spark, sf_dir).where("yr = 1996").join(views.zones(spark, sf_dir), "zone_id")
    pairs = part.select(F.col("community").alias("a"), F.explode(F.map_from_arrays(F.array(F.lit("borough"), F.lit("service_zone")), F.array("borough", "service_zone"))).alias("attribute", "b"))
    return rounded(evolution.agreement(pairs, "attribute"))


@query(
    "SELECT yr - 1 AS before, yr, items AS shared_zones, round(ari, 6) AS ari, round(ami, 6) AS ami FROM sc",
    f"{MAIN_REGION_SQL}, pr AS (SELECT y.yr, x.region AS a, y.region AS b FROM part x JOIN part y ON x.zone_id = y.zone_id AND x.yr = y.yr - 1), {_mutual('pr', 'yr')}",
)
def main_region_alignment(spark, sf_dir):
    return rounded(evolution.alignment(main_regions(spark, sf_dir)))


# --- calibration of all years


@query()
def gravity_by_year(spark, sf_dir):
    """The flows of the test tables hardly depend on distance, so exponents below those of real trips are tried too."""
    return rounded(interaction.calibrate(A.edges(clean_orders(spark, sf_dir), "yr"), views.zones(spark, sf_dir), "yr", low=-1.0))


RADIATION_SQL = f"""{FURNESS_SQL}, ms AS (SELECT id, sum(trips)::DOUBLE AS m FROM (SELECT o AS id, trips FROM de UNION ALL SELECT d, trips FROM de) GROUP BY id),
rp AS (SELECT a.zone_id AS o, b.zone_id AS d, {MILES_SQL} AS miles, x.m AS mo, y.m AS md, ot FROM zones a JOIN zones b ON a.zone_id <> b.zone_id JOIN ms x ON x.id = a.zone_id JOIN ms y ON y.id = b.zone_id JOIN ot ON ot.o = a.zone_id WHERE {MILES_SQL} > 0),
ro AS (SELECT *, (SELECT coalesce(sum(r.md), 0) FROM rp r WHERE r.o = rp.o AND r.miles < rp.miles) AS s FROM rp), rq AS (SELECT *, mo * md / ((mo + s) * (mo + md + s)) AS odds FROM ro),
rm AS (SELECT q.o, q.d, coalesce(trips, 0) AS obs, q.miles, ot * odds / sum(odds) OVER (PARTITION BY q.o) AS model FROM rq q LEFT JOIN de ON de.o = q.o AND de.d = q.d)"""


@query("SELECT o, d, obs, round(miles, 4) AS miles, round(model, 4) AS model FROM rm", RADIATION_SQL)
def radiation_flows(spark, sf_dir):
    return rounded(interaction.radiation(order_edges(spark, sf_dir), views.zones(spark, sf_dir)), 4)


@query("SELECT 'gravity' AS model, round(2 * sum(least(obs, model)) / (sum(obs) + sum(model)), 6) AS cpc FROM fm UNION ALL SELECT 'radiation', round(2 * sum(least(obs, model)) / (sum(obs) + sum(model)), 6) FROM rm", RADIATION_SQL)
def radiation_against_gravity(spark, sf_dir):
    one = lambda model, name: interaction.common_part(model).select(F.lit(name).alias("model"), "cpc")
    return rounded(one(order_furness(spark, sf_dir), "gravity").union(one(interaction.radiation(order_edges(spark, sf_dir), views.zones(spark, sf_dir)), "radiation")))


# --- density of trips


@query(
    """SELECT gx, gy, round(sum(w * exp(-0.5 * pow((gx - x) / hx, 2)) * exp(-0.5 * pow((gy - y) / hy, 2))) / (2 * pi() * max(hx) * max(hy) * max(n)), 8) AS density
FROM cells, pts, sc GROUP BY gx, gy""",
    f"""{EDGES_SQL}, {views.ZONES}, pts AS (SELECT cx_ft / 5280 AS x, cy_ft / 5280 AS y, sum(trips)::DOUBLE AS w FROM e JOIN zones ON zone_id = o WHERE cx_ft IS NOT NULL GROUP BY ALL),
sc AS (SELECT n, sqrt((sxx - sx * sx / n) / (n - 1)) * pow(n, -1 / 6.0::DOUBLE) AS hx, sqrt((syy - sy * sy / n) / (n - 1)) * pow(n, -1 / 6.0::DOUBLE) AS hy FROM (SELECT sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy FROM pts)),
cells AS (SELECT DISTINCT (x + i)::BIGINT AS gx, (y + j)::BIGINT AS gy FROM (SELECT x, y, unnest(range(-floor(hx * 6)::BIGINT, floor(hx * 6)::BIGINT + 1)) AS i, hy FROM pts, sc), unnest(range(-floor(hy * 6)::BIGINT, floor(hy * 6)::BIGINT + 1)) t(j))""",
)
def trip_density(spark, sf_dir):
    """Density of trip origins by mile; the zones' centroids lie on whole miles, so binning moves none."""
    at = views.zones(spark, sf_dir).where("cx_ft is not null").select(F.col("zone_id").alias("o"), (F.col("cx_ft") / 5280).alias("x"), (F.col("cy_ft") / 5280).alias("y"))
    points = order_edges(spark, sf_dir).join(at, "o").select("x", "y", F.col("trips").alias("w"))
    return rounded(density.kernel_density(points, 1.0), 8)


# --- the monthly store


def stored_orders(spark, sf_dir):
    """A store of the orders' clean trips whose first run breaks off, and which is then resumed and has a month redone."""
    trips = store.month_of(clean_orders(spark, sf_dir))
    made = store.Store(spark, Iterates(spark, "store").at)
    try:
        made.build(trips, 48, stop_before="hour_weekday")
    except store.Interrupted:
        pass
    made.build(trips, 48)
    made.redo("m199603")
    made.build(trips, 48)
    return made


@query("SELECT o, d, period, count(*) AS trips, round(sum(dist) + 1e-7, 4) AS sum_dist, round(sum(fare) + 1e-7, 4) AS sum_fare, round(sum(dur) + 1e-7, 4) AS sum_dur FROM (SELECT *, " + DAYPART_SQL + " AS period FROM clean) GROUP BY ALL", CLEAN_SQL)
def resumed_store_edges(spark, sf_dir):
    return rounded(off_ties(stored_orders(spark, sf_dir).merged("daypart_edges")), 4)


@query(
    f"""SELECT 'edges' AS name, count(*) AS groups, sum(n)::BIGINT AS trips FROM (SELECT o, d, count(*) AS n FROM clean GROUP BY ALL)
UNION ALL SELECT 'daypart_edges', count(*), sum(n)::BIGINT FROM (SELECT o, d, {DAYPART_SQL} AS period, count(*) AS n FROM clean GROUP BY ALL)
UNION ALL SELECT 'zone_hourly', count(*), sum(n)::BIGINT FROM (SELECT z, wd >= 5 AS weekend, hr, sum(n) AS n FROM (SELECT o AS z, wd, hr, 1 AS n FROM clean UNION ALL SELECT d, wd, hr, 0 FROM clean) GROUP BY ALL)
UNION ALL SELECT 'monthly_volume', count(*), sum(n)::BIGINT FROM (SELECT mo, count(*) AS n FROM clean GROUP BY ALL)
UNION ALL SELECT 'hour_weekday', count(*), sum(n)::BIGINT FROM (SELECT wd, hr, count(*) AS n FROM clean GROUP BY ALL)
UNION ALL SELECT 'cost_duration', count(*), sum(n)::BIGINT FROM (SELECT least(floor(dur), 120) AS a, least(floor(fare), 120) AS b, count(*) AS n FROM clean GROUP BY ALL)
UNION ALL SELECT 'samples', count(DISTINCT period), sum(least(n, {store.SAMPLE}))::BIGINT FROM (SELECT {DAYPART_SQL} AS period, count(*) AS n FROM clean GROUP BY ALL)""",
    CLEAN_SQL,
)
def resumed_store_tables(spark, sf_dir):
    """Groups and trips of each of the seven tables after the breaks."""
    made, out = stored_orders(spark, sf_dir), []
    for name, (_make, keys, sums) in store.PARTIALS.items():
        merged = made.merged(name)
        trips = F.count(F.lit(1)) if not sums else F.sum(sums[0])
        out.append(merged.agg(F.lit(name).alias("name"), F.count_distinct(*keys).alias("groups"), trips.cast("long").alias("trips")))
    return evolution.unite(out)


# --- streams


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def streamed_hourly_flows(spark, sf_dir):
    """The hourly flows of the events table read as a stream."""
    return rounded(hourly.hourly_flows(spark, sf_dir))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL")
def appended_hourly_flows(spark, sf_dir):
    """Hours that the stream has closed, appended batch by batch."""
    return rounded(hourly.closed_hours(spark, sf_dir))


# --- the whole panel

PANEL_SQL = f"""{CURVES_SQL.replace(" AND mo <= 2", "")}, {views.ZONES}, {ORACLES["year_panel"].split(CLEAN_SQL + ", ", 1)[1].rsplit(chr(10) + "SELECT yr, n_edges", 1)[0].replace("ye AS", "yt AS", 1).replace("FROM ye", "FROM yt")},
long AS (SELECT yr AS k, o, d, greatest({MILES_SQL}, 1e-9) AS len FROM ye JOIN zones a ON a.zone_id = o JOIN zones b ON b.zone_id = d WHERE {MILES_SQL} IS NOT NULL), {_doubled("long", 3)},
wk AS (SELECT yr, o AS a, d AS b FROM ye UNION SELECT yr, d, o FROM ye), c0 AS MATERIALIZED (SELECT yr, a, count(*) AS k FROM wk GROUP BY ALL)"""
for _i in range(1, 9):
    PANEL_SQL += f", c{_i} AS MATERIALIZED (SELECT yr, a, least(max(own), max(least(i, kb))) AS k FROM (SELECT w.yr, w.a, y.k AS own, x.k AS kb, row_number() OVER (PARTITION BY w.yr, w.a ORDER BY x.k DESC) AS i FROM wk w JOIN c{_i - 1} x ON x.yr = w.yr AND x.a = w.b JOIN c{_i - 1} y ON y.yr = w.yr AND y.a = w.a) GROUP BY ALL)"


@query(
    """SELECT yr, n_edges, coalesce(n_nodes, 0)::BIGINT AS n_nodes, total_trips, self_trips, round(mean_dist, 6) AS mean_dist, round(density, 6) AS density, round(weighted_reciprocity, 6) AS weighted_reciprocity,
  round((r - density) / nullif(1 - density, 0), 6) AS reciprocity_rho, round(degree_assortativity, 6) AS degree_assortativity, CAST(core AS INTEGER) AS max_kcore, round(coalesce(paths, 0) / (n_nodes * (n_nodes - 1)), 6) AS global_efficiency, round(schneider_r, 6) AS schneider_r
FROM (SELECT *, n_edges / nullif(n_nodes * (n_nodes - 1), 0)::DOUBLE AS density FROM ysum LEFT JOIN ynodes USING (yr)) LEFT JOIN yrec USING (yr)
LEFT JOIN (SELECT yr, max(k) AS core FROM c8 GROUP BY yr) USING (yr) LEFT JOIN (SELECT k AS yr, sum(1 / len) AS paths FROM m3 WHERE o <> d AND len > 0 GROUP BY k) USING (yr)
LEFT JOIN (SELECT yr, avg(r) AS schneider_r FROM (SELECT yr, seed, avg(largest / n::DOUBLE) AS r FROM curve JOIN (SELECT DISTINCT yr, seed, n FROM ord) USING (yr, seed) GROUP BY ALL) GROUP BY yr) USING (yr)""",
    PANEL_SQL,
)
def year_panel_structure(spark, sf_dir):
    edges = Iterates(spark, "yearly").keep("edges", A.edges(clean_orders(spark, sf_dir), "yr"))
    return rounded(panel.structure_panel(edges, views.zones(spark, sf_dir), SEEDS, EVERY))


@query()
def year_panel_full(spark, sf_dir):
    """All seventeen measures of each year."""
    from odflux.plans.networks import yearly_members

    return rounded(panel.full_panel(A.edges(clean_orders(spark, sf_dir), "yr"), views.zones(spark, sf_dir), yearly_members(spark, sf_dir), low=-1.0))


# --- small tables of years and months

MONTHS_SQL = f"{CLEAN_SQL}, ym AS (SELECT yr, mo, count(*) AS trips FROM clean GROUP BY ALL)"


@query("SELECT f AS from_year, t AS to_year, round((b.trips - a.trips) * 100.0::DOUBLE / a.trips, 6) AS change_pct FROM (VALUES (1995, 1997), (1997, 1998), (1998, 2001), (1990, 1995)) v(f, t) LEFT JOIN yv a ON a.yr = f LEFT JOIN yv b ON b.yr = t", f"{CLEAN_SQL}, yv AS (SELECT yr, count(*) AS trips FROM clean WHERE o <> d GROUP BY yr)")
def fixed_point_changes(spark, sf_dir):
    volumes = clean_orders(spark, sf_dir).where("o <> d").groupBy("yr").agg(F.count(F.lit(1)).alias("trips"))
    return rounded(evolution.fixed_changes(volumes, "trips", [(1995, 1997), (1997, 1998), (1998, 2001), (1990, 1995)]))


@query(
    "SELECT CAST(m // 12 AS INTEGER) AS yr, CAST(m % 12 + 1 AS INTEGER) AS mo, coalesce(trips, 0)::BIGINT AS value, round(coalesce(trips, 0) / (max(coalesce(trips, 0)) OVER ())::DOUBLE, 6) AS share_of_peak, coalesce(trips, 0) = min(coalesce(trips, 0)) OVER () AS is_least FROM (SELECT unnest(range((SELECT min(yr * 12 + mo - 1) FROM ym), (SELECT max(yr * 12 + mo) FROM ym))) AS m) LEFT JOIN ym ON m = yr * 12 + mo - 1",
    MONTHS_SQL,
)
def monthly_timeline(spark, sf_dir):
    monthly = clean_orders(spark, sf_dir).groupBy("yr", "mo").agg(F.count(F.lit(1)).alias("trips"))
    return rounded(evolution.timeline(monthly, "trips"))


@query("SELECT CAST(week(ts) AS INTEGER) AS week, CAST(day(ts) AS INTEGER) AS day, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, count(*) AS events FROM events GROUP BY ALL")
def calendar_counts(spark, sf_dir):
    return views.read(spark, sf_dir, "events").groupBy(F.weekofyear("ts").alias("week"), F.dayofmonth("ts").alias("day"), F.dayofyear("ts").alias("day_of_year")).agg(F.count(F.lit(1)).alias("events"))


@query("SELECT o, d, trips, rank FROM (SELECT o, d, trips, CAST(row_number() OVER (ORDER BY trips DESC, o, d) AS INTEGER) AS rank FROM p) WHERE rank <= 40", EDGES_SQL)
def top_edges_overall(spark, sf_dir):
    """The forty strongest edges over all years; a sort that keeps forty rows, then their ranks."""
    top = A.without_loops(order_edges(spark, sf_dir)).select("o", "d", "trips").orderBy(F.desc("trips"), "o", "d").limit(40)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("trips"), "o", "d")))


@query("SELECT degree, count(*) AS nodes FROM (SELECT id, count(*) AS degree FROM (SELECT o AS id FROM top UNION ALL SELECT d FROM top) GROUP BY id) GROUP BY degree", _main_flows(3))
def degree_sequence(spark, sf_dir):
    ends = main_flows(spark, sf_dir, 3).select(F.explode(F.array("o", "d")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT yr, mo, CASE WHEN trips >= 5 THEN 'frequent' ELSE 'infrequent' END AS class, count(*) AS edges, sum(trips)::BIGINT AS trips, count(DISTINCT o) AS origins FROM (SELECT yr, mo, o, d, count(*) AS trips FROM clean WHERE o <> d GROUP BY ALL) GROUP BY ALL", CLEAN_SQL)
def monthly_frequency_split(spark, sf_dir):
    """Frequent and other edges of each month's graph."""
    kind = F.when(F.col("trips") >= 5, "frequent").otherwise("infrequent").alias("class")
    monthly = A.edges(clean_orders(spark, sf_dir), "yr", "mo").where("o <> d")
    return monthly.groupBy("yr", "mo", kind).agg(F.count(F.lit(1)).alias("edges"), F.sum("trips").alias("trips"), F.count_distinct("o").alias("origins"))


@query("SELECT hr, count(*) AS trips, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value, round(sum(value * n) / sum(n), 6) AS weighted_value FROM (SELECT hr, value, count(*) OVER (PARTITION BY o, d) AS n FROM ev) GROUP BY hr", views.EVENT_TRIPS)
def hourly_weighted_summary(spark, sf_dir):
    """Mean value by hour, plain and weighted by the trips of each trip's edge."""
    trips = views.event_trips(spark, sf_dir).select("o", "d", "hr", "value")
    weight = trips.groupBy("o", "d").agg(F.count(F.lit(1)).alias("n"))
    met = trips.join(weight, ["o", "d"])
    return rounded(met.groupBy("hr").agg(F.count(F.lit(1)).alias("trips"), F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("sd_value"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("weighted_value")))


# --- polygons dissolved

BRICKS_SQL = """bricks AS (SELECT r_name AS borough, 2 * (n_nationkey % 5) + 0.75 * ((n_nationkey // 5) % 2) AS x, n_nationkey // 5 AS y FROM nation JOIN region ON n_regionkey = r_regionkey),
flat AS (SELECT borough, x + 0.25 * i AS a, y AS b, 0.25::DOUBLE AS len, 0 AS kind FROM bricks, unnest(range(8)) t(i) UNION ALL SELECT borough, x + 0.5 + 0.25 * i, y + 1, 0.25, 0 FROM bricks, unnest(range(8)) t(i)
  UNION ALL SELECT borough, x, y, sqrt(1.25), 1 FROM bricks UNION ALL SELECT borough, x + 2, y, sqrt(1.25), 1 FROM bricks),
rim AS (SELECT borough, sum(len) AS perimeter FROM (SELECT borough, any_value(len) AS len FROM flat GROUP BY borough, kind, a, b HAVING count(*) = 1) GROUP BY borough)"""


def bricks(spark, sf_dir):
    """A slanted brick for each nation, laid in rows that are shifted, so that corners lie inside sides."""
    zones = views.read(spark, sf_dir, "nation").join(views.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = F.col("n_nationkey")
    row = F.floor(n / 5)
    x, y = (2 * (n % 5) + 0.75 * (row % 2)).cast("double"), row.cast("double")
    return zones.select("n_nationkey", "n_name", "n_regionkey", F.col("r_name").alias("by"), F.array(x, x + 2, x + 2.5, x + 0.5).alias("xs"), F.array(y, y, y + 1, y + 1).alias("ys"), F.lit(False).alias("hole"))


@query("SELECT borough, round(2.0::DOUBLE * count(*), 6) AS area, round(any_value(perimeter), 6) AS perimeter FROM bricks JOIN rim USING (borough) GROUP BY borough", BRICKS_SQL)
def dissolve_regions(spark, sf_dir):
    """Area and length of outline of the regions that the nations' bricks make."""
    rim = Iterates(spark, "outlines").keep("rim", spatial.outlines(bricks(spark, sf_dir), 2.0))
    area = spatial.rings(rim).groupBy("by").agg(F.sum("area").alias("area"))
    length = rim.groupBy("by").agg(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("perimeter"))
    return rounded(area.join(length, "by").withColumnRenamed("by", "borough"))


@query()
def dissolve_rings(spark, sf_dir):
    return spatial.dissolve_polygons(bricks(spark, sf_dir), 2.0)
