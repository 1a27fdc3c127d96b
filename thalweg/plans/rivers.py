"""Queries on channel profiles and river steepness, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channel, fluvial, series
from ..sources import fixtures as fx
from . import fixture_sql as sql
from .terrain import r6

THETA = 0.45


def _analysed(spark, sf):
    return fluvial.analysed(fx.profiles(spark, sf).drop("area_raw"))


def _breaks(profile, *at):
    return profile.select("basin_id").distinct().select("basin_id", F.explode(F.array(*[F.lit(i).cast("long") for i in at])).alias("idx"))


def ncp_normalized(spark, sf):
    return channel.normalised(fx.profiles(spark, sf)).select("basin_id", "idx", *r6("x", "y", "deviation"))


def ncp_metrics(spark, sf):
    return channel.metrics(channel.normalised(fx.profiles(spark, sf)))


def ncp_fleet(spark, sf):
    return channel.fleet(ncp_metrics(spark, sf)).select("n", "n_max_c", *r6("max_c_mean", "dl_mean", "concavity_mean"))


def ncp_padded_range(spark, sf):
    return channel.padded_range(ncp_metrics(spark, sf), "concavity").select(*r6("low", "high"))


def sl_slk(spark, sf):
    return fluvial.stream_length(fx.profiles(spark, sf)).select("basin_id", "idx", *r6("sl", "slk"))


def chi(spark, sf):
    return fluvial.chi(fx.profiles(spark, sf), THETA).select("basin_id", "idx", *r6("chi"))


def ksn_profile(spark, sf):
    return fluvial.steepness(series.slope(fx.profiles(spark, sf)), THETA).select("basin_id", "idx", F.round("ksn", 4).alias("ksn"))


def theta_local(spark, sf):
    return fluvial.concavity(series.slope(fx.profiles(spark, sf)), THETA).select("basin_id", "idx", *r6("theta_local"))


def theta_again(spark, sf):
    return fluvial.again(_analysed(spark, sf), 0.3).select("basin_id", "idx", *r6("chi"), F.round("ksn", 4).alias("ksn"))


def equilibrium_hack(spark, sf):
    return fluvial.equilibrium(fx.profiles(spark, sf)).select("basin_id", "idx", F.round("equilibrium", 4).alias("equilibrium"))


def chi_line(spark, sf):
    return fluvial.chi_line(_analysed(spark, sf)).select("basin_id", F.round("z_mouth", 3).alias("z_mouth"), F.round("z_source", 3).alias("z_source"))


def knickpoint_first(spark, sf):
    found = fluvial.knickpoints(fluvial.chi(fx.profiles(spark, sf), THETA), depth=1)
    return found.select("basin_id", "idx", F.round("chi", 4).alias("chi"), F.round("elev", 2).alias("elev"))


def knickpoints(spark, sf):
    found = fluvial.knickpoints(_analysed(spark, sf), depth=3)
    dist = _analysed(spark, sf).select("basin_id", "idx", "dist_m")
    return found.join(dist, ["basin_id", "idx"], "left").select("basin_id", "idx", F.round("chi", 4).alias("chi"), F.coalesce(F.round("dist_m", 1), F.lit(0.0)).alias("dist_m"), F.round("elev", 2).alias("elev"))


def _segments(spark, sf, method):
    profile = fluvial.chi(series.slope(fx.profiles(spark, sf)), THETA)
    return profile, fluvial.segments(profile, _breaks(profile, 12, 27), method)


def ksn_segments_chi(spark, sf):
    profile, parts = _segments(spark, sf, "chi_slope")
    return fluvial.reaches(profile, parts).withColumn("drop_m", F.round("drop_m", 2)).withColumn("reach_m", F.round("reach_m", 2))


def ksn_segments_regression(spark, sf):
    return _segments(spark, sf, "regression")[1]


def fluvial_summary(spark, sf):
    return fluvial.summary(_analysed(spark, sf))


def fluvial_fleet(spark, sf):
    found = fluvial.summary(_analysed(spark, sf))
    return found.agg(F.count("*").alias("n"), F.round(F.avg("slk_max"), 6).alias("slk_mean"), F.round(F.avg("ksn_mean"), 6).alias("ksn_mean"))


QUERIES = {
    f.__name__: f
    for f in (
        ncp_normalized, ncp_metrics, ncp_fleet, ncp_padded_range, sl_slk, chi, ksn_profile, theta_local, theta_again, equilibrium_hack, chi_line,
        knickpoint_first, knickpoints, ksn_segments_chi, ksn_segments_regression, fluvial_summary, fluvial_fleet,
    )
}

_P = f"p AS ({sql.PROFILES})"
_NCP = f"""{_P},
a AS (SELECT basin_id, idx, dist_m, elev, MIN(dist_m) OVER w AS d0, MAX(dist_m) OVER w AS d1, MIN(elev) OVER w AS lo, MAX(elev) OVER w AS hi FROM p WINDOW w AS (PARTITION BY basin_id)),
n AS (SELECT basin_id, idx, (dist_m-d0)/(d1-d0) AS x, (elev-lo)/(hi-lo) AS y, (1 - (dist_m-d0)/(d1-d0)) - (elev-lo)/(hi-lo) AS deviation FROM a WHERE d1-d0 > 1e-10 AND hi-lo > 1e-10),
t AS (SELECT *, (deviation + LAG(deviation) OVER w)/2*(x - LAG(x) OVER w) AS s FROM n WINDOW w AS (PARTITION BY basin_id ORDER BY idx)),
b AS (SELECT basin_id, deviation, x, y FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY basin_id ORDER BY deviation DESC, idx) AS rn FROM n WHERE deviation > 0) q WHERE rn = 1),
m AS (SELECT t.basin_id, ANY_VALUE(round(b.deviation, 4)) AS max_c, ANY_VALUE(round(b.x, 4)) AS dl, ANY_VALUE(round(b.y, 4)) AS y_at_dl, ANY_VALUE(round(1 - b.x, 4)) AS diagonal_at_dl, round(SUM(s)/0.5*100, 2) AS concavity
  FROM t LEFT JOIN b USING (basin_id) GROUP BY t.basin_id)"""
_SL = """g AS (SELECT *, LEAD(elev) OVER w AS z2, LEAD(dist_m) OVER w AS d2, LAG(elev) OVER w AS z0, LAG(dist_m) OVER w AS d0,
  abs(FIRST_VALUE(elev) OVER f - LAST_VALUE(elev) OVER f) AS h, LAST_VALUE(dist_m) OVER f AS l FROM p
  WINDOW w AS (PARTITION BY basin_id ORDER BY idx), f AS (PARTITION BY basin_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
sl AS (SELECT *, CASE WHEN d2 IS NULL THEN (z0 - elev)/(dist_m - d0)*dist_m WHEN d2 - dist_m < 1e-6 THEN 0.0 ELSE GREATEST((elev - z2)/(d2 - dist_m)*dist_m, 0.0) END AS sl FROM g),
sk AS (SELECT *, CASE WHEN l > 1 AND h > 0 THEN sl / GREATEST(h/ln(l), 1e-10) ELSE sl END AS slk FROM sl)"""


def _chi(theta: float, source: str = "p") -> str:
    return f"""w AS (SELECT *, pow(1.0/area_m2, {theta}) AS wt FROM {source}),
v AS (SELECT *, coalesce((wt + LEAD(wt) OVER o)/2*(LEAD(dist_m) OVER o - dist_m), 0) AS st FROM w WINDOW o AS (PARTITION BY basin_id ORDER BY idx)),
ch AS (SELECT * EXCLUDE (wt, st), SUM(st) OVER (PARTITION BY basin_id ORDER BY idx DESC ROWS UNBOUNDED PRECEDING) AS chi FROM v)"""


def _slope(source: str) -> str:
    return f"""sa AS (SELECT *, coalesce(LEAD(elev) OVER o, elev) - coalesce(LAG(elev) OVER o, elev) AS dz, coalesce(LEAD(dist_m) OVER o, dist_m) - coalesce(LAG(dist_m) OVER o, dist_m) AS dd
  FROM {source} WINDOW o AS (PARTITION BY basin_id ORDER BY idx)),
sp AS (SELECT * EXCLUDE (dz, dd), CASE WHEN dd > 1e-6 THEN GREATEST(abs(dz)/dd, 1e-8) ELSE 1e-8 END AS slope FROM sa)"""


def _ksn(theta: float) -> str:
    k = f"slope*pow(area_m2, {theta})"
    return f"CASE WHEN {k} > 0 AND {k} < 1500 THEN {k} END"


_THETA = f"""th0 AS (SELECT *, COUNT(*) OVER b AS n, (LAST_VALUE(dist_m) OVER f - FIRST_VALUE(dist_m) OVER f)/COUNT(*) OVER b AS sp FROM sp
  WINDOW b AS (PARTITION BY basin_id), f AS (PARTITION BY basin_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
th1 AS (SELECT *, GREATEST(8, CASE WHEN CAST(FLOOR(125.0/sp) AS BIGINT) % 2 = 0 THEN CAST(FLOOR(125.0/sp) AS BIGINT) + 1 ELSE CAST(FLOOR(125.0/sp) AS BIGINT) END) AS win FROM th0),
th AS (SELECT a.basin_id, a.idx, CASE WHEN ANY_VALUE(a.n > a.win AND a.idx >= a.win//2 AND a.idx - a.win//2 + a.win - 1 <= a.n - 1)
  THEN CASE WHEN regr_sxx(log10(GREATEST(b.slope, 1e-10)), log10(GREATEST(b.area_m2, 1e-6))) <= 1e-6 THEN 0.0 ELSE abs(regr_slope(log10(GREATEST(b.slope, 1e-10)), log10(GREATEST(b.area_m2, 1e-6)))) END ELSE {THETA} END AS theta_local
  FROM th1 a JOIN th1 b ON a.basin_id = b.basin_id AND b.idx BETWEEN a.idx - a.win//2 AND a.idx - a.win//2 + a.win - 1 GROUP BY a.basin_id, a.idx)"""
_SUMMARY = f"""{_P}, {_SL}, {_slope("sk")}, {_chi(THETA, "sp")}, {_THETA},
su AS (SELECT ch.basin_id, coalesce(round(MAX(sl), 2), 0) AS sl_max, coalesce(round(MAX(slk), 4), 0) AS slk_max, coalesce(round(MAX(chi), 4), 0) AS chi_max, coalesce(round(AVG({_ksn(THETA)}), 2), 0) AS ksn_mean,
  coalesce(round(MAX({_ksn(THETA)}), 2), 0) AS ksn_max, coalesce(round(AVG(theta_local), 4), 0) AS theta_mean FROM ch JOIN th ON th.basin_id = ch.basin_id AND th.idx = ch.idx GROUP BY ch.basin_id)"""
_PARTS = f"""{_P}, {_slope("p")}, {_chi(THETA, "sp")},
bd AS (SELECT basin_id, unnest([0, 12, 27, MAX(idx)]) AS idx FROM p GROUP BY basin_id),
sg AS (SELECT basin_id, idx AS i0, LEAD(idx) OVER (PARTITION BY basin_id ORDER BY idx) AS i1 FROM (SELECT DISTINCT * FROM bd) q),
mt AS (SELECT ch.*, i0, i1, CASE WHEN idx < i1 AND slope > 1e-6 THEN log10(area_m2) END AS lx, CASE WHEN idx < i1 AND slope > 1e-6 THEN log10(slope) END AS ly
  FROM ch JOIN sg ON ch.basin_id = sg.basin_id AND idx BETWEEN i0 AND i1 WHERE i1 - i0 >= 8),
pt AS (SELECT basin_id, i0, i1, MAX(CASE WHEN idx = i0 THEN chi END) AS c0, MAX(CASE WHEN idx = i1 THEN chi END) AS c1, MAX(CASE WHEN idx = i0 THEN elev END) AS z0, MAX(CASE WHEN idx = i1 THEN elev END) AS z1,
  MAX(CASE WHEN idx = i0 THEN dist_m END) AS d0, MAX(CASE WHEN idx = i1 THEN dist_m END) AS d1, COUNT(lx) AS n, regr_slope(ly, lx) AS s, regr_intercept(ly, lx) AS c, MIN(lx) AS lo, MAX(lx) AS hi FROM mt GROUP BY basin_id, i0, i1)"""
_ENDS = "basin_id, i0, i1, round(c0, 4) AS chi_start, round(c1, 4) AS chi_end, CAST(round(CAST(z0 AS DECIMAL(18,6)), 2) AS DOUBLE) AS elev_start, CAST(round(CAST(z1 AS DECIMAL(18,6)), 2) AS DOUBLE) AS elev_end"
_RSS = "({0}yy - {0}y*{0}y/{1} - pow({0}xy - {0}x*{0}y/{1}, 2)/({0}xx - {0}x*{0}x/{1}))"

def _splits_sql(source: str, depth: int, points: int = 8) -> str:
    """CTEs up to ``kp`` (basin_id, b): breaks of ``source`` (basin_id, idx, chi, elev) by two lines of least squares on each level."""
    rss = lambda side: f"(regr_syy(p.elev, p.chi) FILTER ({side}) - pow(regr_sxy(p.elev, p.chi) FILTER ({side}), 2)/regr_sxx(p.elev, p.chi) FILTER ({side}))"
    parts = [f"kv AS (SELECT basin_id, idx, chi, elev, ROW_NUMBER() OVER (PARTITION BY basin_id ORDER BY idx) - 1 AS k, COUNT(*) OVER (PARTITION BY basin_id) AS n FROM {source} WHERE chi IS NOT NULL AND elev IS NOT NULL)", "s0 AS (SELECT DISTINCT basin_id, 0 AS i, n AS j FROM kv)"]
    for level in range(depth):
        parts.append(
            f"c{level} AS (SELECT s.basin_id, s.i, s.j, q.k AS b, {rss('p.k < q.k')} + {rss('p.k >= q.k')} AS r FROM s{level} s JOIN kv q ON q.basin_id = s.basin_id AND s.j - s.i > {2 * points} AND q.k BETWEEN s.i + {points} AND s.j - {points} - 1"
            " JOIN kv p ON p.basin_id = s.basin_id AND p.k >= s.i AND p.k < s.j GROUP BY ALL)"
        )
        parts.append(f"b{level} AS (SELECT basin_id, i, j, FIRST(b ORDER BY r, b) AS b FROM c{level} GROUP BY ALL)")
        parts.append(f"s{level + 1} AS (SELECT basin_id, i, b AS j FROM b{level} UNION ALL SELECT basin_id, b, j FROM b{level})")
    every = " UNION ".join(f"SELECT basin_id, b FROM b{level}" for level in range(depth))
    parts.append(f"kp AS (SELECT basin_id, b FROM ({every}) u QUALIFY ROW_NUMBER() OVER (PARTITION BY basin_id ORDER BY b) <= {depth})")
    return ", ".join(parts)


ORACLES = {
    "knickpoints": f"""WITH {_P}, {_chi(THETA)}, {_splits_sql('ch', 3)}
SELECT kv.basin_id, kv.idx, round(kv.chi, 4) AS chi, round(p.dist_m, 1) AS dist_m, CAST(round(CAST(kv.elev AS DECIMAL(18,6)), 2) AS DOUBLE) AS elev FROM kp JOIN kv ON kv.basin_id = kp.basin_id AND kv.k = kp.b JOIN p ON p.basin_id = kv.basin_id AND p.idx = kv.idx""",
    "ncp_normalized": f"WITH {_NCP} SELECT basin_id, idx, round(x, 6) AS x, round(y, 6) AS y, round(deviation, 6) AS deviation FROM n",
    "ncp_metrics": f"WITH {_NCP} SELECT * FROM m",
    "ncp_fleet": f"WITH {_NCP} SELECT COUNT(*) AS n, COUNT(max_c) AS n_max_c, round(AVG(max_c), 6) AS max_c_mean, round(AVG(dl), 6) AS dl_mean, round(AVG(concavity), 6) AS concavity_mean FROM m",
    "ncp_padded_range": f"WITH {_NCP}, k AS (SELECT MIN(concavity) AS lo, MAX(concavity) AS hi FROM m) SELECT round(lo - (hi-lo)*0.12, 6) AS low, round(hi + (hi-lo)*0.12, 6) AS high FROM k",
    "sl_slk": f"WITH {_P}, {_SL} SELECT basin_id, idx, round(sl, 6) AS sl, round(slk, 6) AS slk FROM sk",
    "chi": f"WITH {_P}, {_chi(THETA)} SELECT basin_id, idx, round(chi, 6) AS chi FROM ch",
    "ksn_profile": f"WITH {_P}, {_slope('p')} SELECT basin_id, idx, round({_ksn(THETA)}, 4) AS ksn FROM sp",
    "theta_local": f"WITH {_P}, {_slope('p')}, {_THETA} SELECT basin_id, idx, round(theta_local, 6) AS theta_local FROM th",
    "theta_again": f"WITH {_P}, {_slope('p')}, {_chi(0.3, 'sp')} SELECT basin_id, idx, round(chi, 6) AS chi, round({_ksn(0.3)}, 4) AS ksn FROM ch",
    "equilibrium_hack": f"""WITH {_P}, a AS (SELECT *, CASE WHEN dist_m > 0 THEN dist_m ELSE MIN(CASE WHEN dist_m > 0 THEN dist_m END) OVER (PARTITION BY basin_id) END AS d FROM p),
e AS (SELECT *, MAX(elev) OVER w AS hi, MIN(elev) OVER w AS lo, log10(MIN(d) OVER w) AS l0, log10(MAX(d) OVER w) AS l1 FROM a WINDOW w AS (PARTITION BY basin_id))
SELECT basin_id, idx, round(CASE WHEN abs(l1-l0) < 1e-10 THEN (hi+lo)/2 ELSE hi - (hi-lo)/(l1-l0)*(log10(d)-l0) END, 4) AS equilibrium FROM e""",
    "chi_line": f"""WITH {_P}, {_slope('p')}, {_chi(THETA, 'sp')}, k AS (SELECT *, {_ksn(THETA)} AS ksn FROM ch)
SELECT basin_id, round(arg_max(elev, idx), 3) AS z_mouth, round(arg_max(elev, idx) + AVG(ksn)*(MAX(chi)-MIN(chi)), 3) AS z_source FROM k GROUP BY basin_id""",
    "knickpoint_first": f"""WITH {_P}, {_chi(THETA)}, c AS (SELECT *, chi - AVG(chi) OVER b AS x, elev - AVG(elev) OVER b AS y, COUNT(*) OVER b AS n FROM ch WINDOW b AS (PARTITION BY basin_id)),
s AS (SELECT basin_id, idx, chi, elev, n, SUM(x) OVER r AS lx, SUM(y) OVER r AS ly, SUM(x*x) OVER r AS lxx, SUM(x*y) OVER r AS lxy, SUM(y*y) OVER r AS lyy,
  SUM(x) OVER b AS tx, SUM(y) OVER b AS ty, SUM(x*x) OVER b AS txx, SUM(x*y) OVER b AS txy, SUM(y*y) OVER b AS tyy FROM c
  WINDOW b AS (PARTITION BY basin_id), r AS (PARTITION BY basin_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, tx-lx AS rx, ty-ly AS ry, txx-lxx AS rxx, txy-lxy AS rxy, tyy-lyy AS ryy FROM s WHERE idx >= 8 AND idx < n - 8),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY basin_id ORDER BY {_RSS.format('l', 'idx')} + {_RSS.format('r', '(n-idx)')}, idx) AS rn FROM q)
SELECT basin_id, idx, round(chi, 4) AS chi, CAST(round(CAST(elev AS DECIMAL(18,6)), 2) AS DOUBLE) AS elev FROM k WHERE rn = 1""",
    "ksn_segments_chi": f"""WITH {_PARTS} SELECT {_ENDS}, round(CASE WHEN abs(c0-c1) > 1e-6 THEN abs(z0-z1)/abs(c0-c1) ELSE 0 END, 2) AS ksn, round(CASE WHEN n > 8 THEN abs(s) ELSE {THETA} END, 4) AS theta_local,
round(abs(CAST(round(CAST(z0 AS DECIMAL(18,6)), 2) AS DOUBLE)-CAST(round(CAST(z1 AS DECIMAL(18,6)), 2) AS DOUBLE)), 2) AS drop_m, round(abs(d1-d0), 2) AS reach_m FROM pt""",
    "ksn_segments_regression": f"""WITH {_PARTS} SELECT {_ENDS}, round(pow(10, c)*pow(pow(10, (hi+lo)/2), {THETA} - abs(s)), 2) AS ksn, round(abs(s), 4) AS theta_local FROM pt WHERE n >= 8 AND hi - lo >= 0.01""",
    "fluvial_summary": f"WITH {_SUMMARY} SELECT * FROM su",
    "fluvial_fleet": f"WITH {_SUMMARY} SELECT COUNT(*) AS n, round(AVG(slk_max), 6) AS slk_mean, round(AVG(ksn_mean), 6) AS ksn_mean FROM su",
}
