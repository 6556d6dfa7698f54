"""Queries of the verification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.operators import verify
from orbitframe.plans.registry import query
from orbitframe.sources.fixtures import OBS_SQL, obs

V = "surface_precip >= 0 AND surface_precip_ref >= 0"
ICE = V + " AND surface_type NOT IN (2, 16)"
FROZEN = " AND mask NOT IN (3, 4, 7)"
LOG = "least(floor(round((log10(surface_precip_ref) - {a}) * {n} / {w}, 9)), {n} - 1)::INT"
TYPES = {"stratiform": [1, 2], "convective": [6, 7, 96], "tropical": [10, 91], "snow": [3, 4]}


def rounded(df, shift=0.0):
    """Six digits; a shift moves values off the middle between two of them."""
    return df.select(*(F.round(F.col(c) + shift, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _bin(c: str, lo: float, hi: float, n: int) -> str:
    import math

    return f"CASE WHEN {c} >= {lo} AND {c} <= {hi} THEN least(floor(round((log10({c}) - {math.log10(lo)!r}::DOUBLE) * {n} / {math.log10(hi) - math.log10(lo)!r}::DOUBLE, 9)), {n - 1})::INT END"


@query("a33_error_metrics", f"""WITH {OBS_SQL} SELECT grp, round(avg(surface_precip - surface_precip_ref) * 100 / avg(surface_precip_ref), 6) AS bias, round(avg(abs(surface_precip - surface_precip_ref)), 6) AS mae,
 round(avg((surface_precip - surface_precip_ref) ** 2), 6) AS mse, round(covar_pop(surface_precip, surface_precip_ref) / nullif(stddev_pop(surface_precip) * stddev_pop(surface_precip_ref), 0), 6) AS correlation,
 round(avg(100 * abs(surface_precip - surface_precip_ref) / (0.5 * (surface_precip + surface_precip_ref))) FILTER (WHERE surface_precip_ref > 0.1), 6) AS smape, count(*) AS n
 FROM obs WHERE {ICE} AND rqi > 0.2 AND surface_type > 1 GROUP BY grp""")
def error_metrics(spark, sf):
    return rounded(verify.error_metrics(obs(spark, sf), ["grp"], no_ocean=True))


@query("a30_type_contribution", f"""WITH {OBS_SQL}, v AS (SELECT * FROM obs WHERE {V}) """ + " UNION ALL ".join(f"SELECT '{k}' AS precip_type, round(sum(surface_precip_ref) FILTER (WHERE mask IN ({', '.join(map(str, t))})) / sum(surface_precip_ref) FILTER (WHERE mask > 0), 6) AS contribution FROM v" for k, t in TYPES.items()))
def contribution(spark, sf):
    return rounded(verify.type_contribution(obs(spark, sf), TYPES))


@query("a31_conditional_pdf", f"""WITH {OBS_SQL}, b AS (SELECT {_bin('surface_precip_ref', .01, 100., 100)} AS ref_bin, {_bin('surface_precip', .01, 100., 100)} AS bin FROM obs WHERE {ICE}),
 c AS (SELECT ref_bin, bin, count(*) AS n FROM b WHERE ref_bin IS NOT NULL AND bin IS NOT NULL GROUP BY ALL)
 SELECT ref_bin, bin, n, round(n / sum(n) OVER (PARTITION BY ref_bin) / (0.01 * (pow(pow(10000.0::DOUBLE, 0.01), bin + 1) - pow(pow(10000.0::DOUBLE, 0.01), bin))), 6) AS density FROM c""")
def pdf(spark, sf):
    return rounded(verify.conditional_pdf(obs(spark, sf)))


@query("a32_conditional_mean", f"""WITH {OBS_SQL}, b AS (SELECT {_bin('surface_precip_ref', .01, 100., 100)} AS ref_bin, surface_precip FROM obs WHERE {ICE})
 SELECT ref_bin, round(avg(surface_precip), 6) AS mean, count(*) AS n FROM b WHERE ref_bin IS NOT NULL GROUP BY ref_bin""")
def cond_mean(spark, sf):
    return rounded(verify.conditional_mean(obs(spark, sf)))


@query("a34_explained_error", f"""WITH {OBS_SQL} SELECT grp, round(regr_r2(surface_precip - surface_precip_ref, tcwv / 10 - surface_precip_ref), 6) AS r2, count(*) AS n FROM obs
 WHERE {V} AND (surface_type < 8 OR surface_type > 11) AND mask NOT IN (3, 4) AND rqi > 0.2 AND tcwv / 10 >= 0 GROUP BY grp""")
def explained(spark, sf):
    return rounded(verify.explained_error(obs(spark, sf), F.col("tcwv") / 10, ["grp"]))


@query("a35_monthly_statistics", f"""WITH {OBS_SQL} SELECT month(scan_time)::INT AS month, round(avg(surface_precip_ref - surface_precip), 6) AS bias, round(covar_pop(surface_precip, surface_precip_ref) / nullif(stddev_pop(surface_precip) * stddev_pop(surface_precip_ref), 0), 6) AS correlation, count(*) AS n
 FROM obs WHERE {V} AND (surface_type < 8 OR surface_type > 11) AND surface_type < 17{FROZEN} GROUP BY 1""")
def monthly(spark, sf):
    return rounded(verify.monthly_statistics(obs(spark, sf)))


def _cycle(phase: str, name: str, period: int, half: int, first: int) -> str:
    return f"""WITH {OBS_SQL}, m AS (SELECT ({phase})::INT AS {name}, avg(surface_precip) AS sp, avg(surface_precip_ref) AS ref FROM obs WHERE {V}{FROZEN} GROUP BY 1)
 SELECT m.{name}, round(m.sp, 6) AS sp, round(m.ref, 6) AS ref, round(avg(o.sp), 6) AS sp_smooth, round(avg(o.ref), 6) AS ref_smooth FROM m JOIN m o
 ON least((m.{name} - o.{name} + {period}) % {period}, (o.{name} - m.{name} + {period}) % {period}) <= {half} GROUP BY ALL"""


@query("a36_seasonal_cycle", _cycle("month(scan_time)", "month", 12, 1, 1))
def seasonal(spark, sf):
    return rounded(verify.seasonal_cycle(obs(spark, sf)))


@query("a37_diurnal_cycle", _cycle("hour(scan_time + to_seconds(trunc(longitude * 240)::INT))", "hour", 24, 3, 0))
def diurnal(spark, sf):
    return rounded(verify.diurnal_cycle(obs(spark, sf)))


GRID = f"""SELECT {{k}}CASE WHEN longitude >= -180 AND longitude < 180 THEN floor((longitude + 180) / 20)::INT WHEN longitude = 180 THEN 17 END AS lon_bin, CASE WHEN latitude >= -90 AND latitude < 90 THEN floor((latitude + 90) / 20)::INT WHEN latitude = 90 THEN 8 END AS lat_bin, count(*) AS n,
 CASE WHEN count(*) >= 5 THEN round(avg(surface_precip - surface_precip_ref) + 1e-9, 6) END AS bias, CASE WHEN count(*) >= 5 THEN round(avg(abs(surface_precip - surface_precip_ref)) + 1e-9, 6) END AS mae,
 CASE WHEN count(*) >= 5 THEN round(avg((surface_precip - surface_precip_ref) ** 2) + 1e-9, 6) END AS mse, CASE WHEN count(*) >= 5 THEN round(covar_pop(surface_precip, surface_precip_ref) / nullif(stddev_pop(surface_precip) * stddev_pop(surface_precip_ref), 0) + 1e-9, 6) END AS correlation FROM obs WHERE {ICE}{FROZEN} GROUP BY ALL"""


@query("a38_gridded", f"WITH {OBS_SQL} " + GRID.format(k=""))
def gridded(spark, sf):
    return rounded(verify.gridded(obs(spark, sf)), 1e-9)


@query("a50_grouped_maps", f"WITH {OBS_SQL} " + GRID.format(k="grp, "))
def grouped_maps(spark, sf):
    return rounded(verify.gridded(obs(spark, sf), by=("grp",)), 1e-9)


@query("a39_pr_curve", f"""WITH {OBS_SQL}, c AS (SELECT surface_precip AS threshold, count(*) FILTER (WHERE surface_precip_ref > 1e-4) AS hits, count(*) AS n FROM obs WHERE {ICE}{FROZEN} GROUP BY 1)
 SELECT threshold, round(sum(hits) OVER w / sum(n) OVER w, 6) AS precision, round(sum(hits) OVER w / sum(hits) OVER (), 6) AS recall FROM c WINDOW w AS (ORDER BY threshold DESC)""")
def pr(spark, sf):
    return rounded(verify.pr_curve(obs(spark, sf), F.col("surface_precip")))


@query("a46_detection", f"""WITH {OBS_SQL} SELECT grp, round(count(*) FILTER (WHERE surface_precip_ref > 0 AND surface_precip > 1) / count(*) FILTER (WHERE surface_precip > 1), 6) AS precision,
 round(count(*) FILTER (WHERE surface_precip_ref <= 1e-4 AND surface_precip > 1) / count(*) FILTER (WHERE surface_precip > 1), 6) AS far, round(avg(surface_precip - surface_precip_ref), 6) AS bias FROM obs WHERE {ICE} GROUP BY grp""")
def detection(spark, sf):
    return rounded(verify.detection(obs(spark, sf), ["grp"]))


@query("a47_error_by_rate", f"""WITH {OBS_SQL}, b AS (SELECT {_bin('surface_precip_ref', .05, 150., 30)} AS ref_bin, surface_precip AS s, surface_precip_ref AS r FROM obs WHERE {ICE})
 SELECT ref_bin, round(sum((s - r) ** 2), 6) AS squared, round(sum(abs(s - r)), 6) AS absolute, round(sum(abs(s - r) / (0.5 * (s + r))) FILTER (WHERE r > 0.1), 6) AS symmetric FROM b WHERE ref_bin IS NOT NULL GROUP BY ref_bin""")
def by_rate(spark, sf):
    return rounded(verify.error_by_rate(obs(spark, sf)))


@query("a49_monthly_counts", f"WITH {OBS_SQL} SELECT strftime(date_trunc('month', scan_time), '%Y-%m') AS month, count(*) AS n FROM obs GROUP BY 1")
def monthly_counts(spark, sf):
    return obs(spark, sf).groupBy(F.date_format("scan_time", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("a40_bootstrap_mean", f"""WITH {OBS_SQL}, w AS (SELECT draw, surface_precip AS x, (sample_id * 1103515245 + draw * 12345 + (sample_id * draw) % 97) % 4 AS w FROM obs, range(1, 21) r(draw) WHERE surface_precip IS NOT NULL),
 m AS (SELECT draw, sum(w * x) / sum(w) AS m FROM w GROUP BY draw) SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM m""")
def bootstrap(spark, sf):
    return rounded(verify.bootstrap_mean(obs(spark, sf), F.col("surface_precip"), F.col("sample_id")))
