"""Swath tables as projections of the provided star-schema tables, in integer arithmetic so that any engine gets the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBS = r"""
SELECT event_id AS sample_id, event_id div 1000 AS granule, (event_id div 25) % 40 AS scan, event_id % 25 AS pixel, ts AS scan_time,
  cast((event_id*7919) % 17999 - 8999 as double)/100 AS latitude, cast((event_id*104729) % 35999 - 17999 as double)/100 AS longitude,
  cast(1 + event_id % 18 as int) AS surface_type, cast((event_id div 18) % 4 as int) AS airmass_type,
  case when event_id % 29 = 0 then null when event_type='error' then 0D else cast(value as double)/10 end AS surface_precip,
  case when event_id % 31 = 0 then null else cast(get_json_object(props,'$.k') as bigint)/20D end AS surface_precip_ref,
  cast(2395 + (event_id*31) % 1000 as double)/10 AS t2m, cast((event_id*17) % 1000 as double)/10 - 0.5D AS tcwv,
  element_at(array(0,1,2,3,4,6,7,10,91,96), cast(event_id % 10 as int)+1) AS mask, cast(event_id % 101 as double)/100 AS rqi,
  case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end AS grp
FROM {events}"""

#: The same for DuckDB, as the head of a WITH clause.
OBS_SQL = r"""obs AS (
SELECT event_id AS sample_id, event_id // 1000 AS granule, (event_id // 25) % 40 AS scan, event_id % 25 AS pixel, ts AS scan_time,
  ((event_id*7919) % 17999 - 8999)::DOUBLE/100 AS latitude, ((event_id*104729) % 35999 - 17999)::DOUBLE/100 AS longitude,
  (1 + event_id % 18)::INT AS surface_type, ((event_id // 18) % 4)::INT AS airmass_type,
  case when event_id % 29 = 0 then null when event_type='error' then 0::DOUBLE else value::DOUBLE/10 end AS surface_precip,
  case when event_id % 31 = 0 then null else json_extract_string(props,'$.k')::BIGINT/20::DOUBLE end AS surface_precip_ref,
  (2395 + (event_id*31) % 1000)::DOUBLE/10 AS t2m, ((event_id*17) % 1000)::DOUBLE/10 - 0.5::DOUBLE AS tcwv,
  list_extract([0,1,2,3,4,6,7,10,91,96], (event_id % 10)::INT + 1) AS mask, (event_id % 101)::DOUBLE/100 AS rqi,
  case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end AS grp
FROM events)"""

SWATH_SQL = OBS_SQL + """, swath AS (SELECT *, (-5000 + (granule % 10)*1000 + scan*12)::DOUBLE/100 AS lat, (-13000 + pixel*15)::DOUBLE/100 AS lon FROM obs),
other AS (SELECT *, lat + ((sample_id*37) % 21 - 10)::DOUBLE/1000 AS lat2, lon + ((sample_id*37) % 21 - 10)::DOUBLE/1000 AS lon2 FROM swath WHERE sample_id % 2 = 1)"""

TB_SQL = "tb AS (SELECT vec_id, label AS surface_type, list_transform(embedding[1:15], lambda x: 220::DOUBLE + 100::DOUBLE * x::DOUBLE) AS tb, list_transform(embedding[1:28], lambda x: x::DOUBLE) AS profile FROM embeddings)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OBS, events=table(spark, sf_dir, "events"))


def swath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).withColumns({"lat": (-5000 + (F.col("granule") % 10) * 1000 + F.col("scan") * 12).cast("double") / 100, "lon": (-13000 + F.col("pixel") * 15).cast("double") / 100})


def other_swath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second pixel, moved a little."""
    shift = ((F.col("sample_id") * 37) % 21 - 10).cast("double") / 1000
    return swath(spark, sf_dir).where("sample_id % 2 = 1").withColumns({"lat2": F.col("lat") + shift, "lon2": F.col("lon") + shift})


def tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen channels and a profile of 28 layers a row."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("surface_type"), F.transform(F.slice(e, 1, 15), lambda x: 220.0 + 100.0 * x.cast("double")).alias("tb"), F.transform(F.slice(e, 1, 28), lambda x: x.cast("double")).alias("profile"))


def histogram_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(surface_type, channel, tb, tcwv, scan_time) samples."""
    return table(spark, sf_dir, "lineitem").select((1 + F.col("l_partkey") % 18).cast("int").alias("surface_type"), F.col("l_linenumber").cast("int").alias("channel"), (F.col("l_extendedprice").cast("double") / 250).alias("tb"), F.col("l_quantity").cast("double").alias("tcwv"), F.col("l_shipdate").alias("scan_time"))


HIST_SQL = "hist AS (SELECT (1 + l_partkey % 18)::INT AS surface_type, l_linenumber::INT AS channel, l_extendedprice::DOUBLE/250 AS tb, l_quantity::DOUBLE AS tcwv, l_shipdate AS scan_time FROM lineitem)"
