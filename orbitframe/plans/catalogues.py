"""Queries of granule catalogues and layouts: which file, which scan, which text."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitframe.plans.registry import query
from orbitframe.plans.verification import rounded
from orbitframe.sources.fixtures import OBS_SQL, obs, table


@query("s05_scan_access", f"WITH {OBS_SQL} SELECT granule, min(scan_time) AS first_time, count(*) FILTER (WHERE scan = 39) AS n_last FROM obs GROUP BY granule")
def s05(spark, sf):
    return obs(spark, sf).groupBy("granule").agg(F.min("scan_time").alias("first_time"), F.count_if(F.col("scan") == 39).alias("n_last"))


@query("s08_day_of_month", "SELECT o_orderkey, o_custkey FROM orders WHERE day(o_orderdate) = 5")
def s08(spark, sf):
    return table(spark, sf, "orders").where(F.dayofmonth("o_orderdate") == 5).select("o_orderkey", "o_custkey")


@query("s10_granule_at_time", "WITH g AS (SELECT range AS granule, DATE '1992-01-01' + (range * 10)::INT AS t0, DATE '1992-01-01' + (range * 10 + 9)::INT AS t1 FROM range(400)) SELECT o_orderkey, granule FROM orders JOIN g ON o_orderdate::DATE BETWEEN t0 AND t1")
def s10(spark, sf):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", F.floor(day / 10).alias("granule")).where("granule between 0 and 399")


@query("s22_result_catalogue", "SELECT o_orderkey % 100 AS granule, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS groups FROM orders GROUP BY 1")
def s22(spark, sf):
    return table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 100).alias("granule")).agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("groups"))


@query("p10_date_range", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1995-04-01'")
def p10(spark, sf):
    return table(spark, sf, "orders").where("o_orderdate >= date '1995-01-01' and o_orderdate < date '1995-04-01'").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("k11_text_table", f"WITH {OBS_SQL} SELECT format('{{:3d}}{{:8.2f}}', surface_type, round(avg(tcwv), 2)) AS line FROM obs GROUP BY surface_type")
def k11(spark, sf):
    return obs(spark, sf).groupBy("surface_type").agg(F.avg("tcwv").alias("t")).select(F.format_string("%3d%8.2f", "surface_type", F.round("t", 2)).alias("line"))


@query("k10_normalised", f"WITH {OBS_SQL} SELECT airmass_type, round(sum(surface_precip) / nullif(count(surface_precip), 0), 6) AS mean FROM obs GROUP BY airmass_type")
def k10(spark, sf):
    df = obs(spark, sf).groupBy("airmass_type").agg(F.sum("surface_precip").alias("s"), F.count("surface_precip").alias("n"))
    return rounded(df.select("airmass_type", F.try_divide("s", F.col("n").cast("double")).alias("mean")))


@query("a48_effective_resolution", "WITH c AS (SELECT l_linenumber AS scale, avg(l_discount::DOUBLE) * l_linenumber AS coherence FROM lineitem GROUP BY l_linenumber), n AS (SELECT *, lead(scale) OVER (ORDER BY scale) AS s1, lead(coherence) OVER (ORDER BY scale) AS c1 FROM c) SELECT round(min(scale + (s1 - scale) * (0.2 - coherence) / (c1 - coherence)), 6) AS resolution FROM n WHERE coherence < 0.2 AND c1 >= 0.2")
def a48(spark, sf):
    from orbitframe.operators.sequence import crossing

    c = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("scale")).agg((F.avg(F.col("l_discount").cast("double"))).alias("d")).select("scale", (F.col("d") * F.col("scale")).alias("coherence"))
    return rounded(crossing(c, [], "scale", "coherence", 0.2).select(F.col("at").alias("resolution")))
