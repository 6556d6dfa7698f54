"""Profile clusters: files of mean profiles by temperature class, species and cluster, and profiles of pixels that name a cluster and a scale.

A file has one profile of 28 layers after the other and nothing else; temperature varies slowest, the cluster fastest. Files of raining pixels have
five species, others one. A pixel's code is 1 to 40 for a raining cluster, 41 to 80 for another; other codes have no profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.functions.clean import null_if_missing
from orbitframe.sources import swathfiles

TEMPERATURES, CLUSTERS = 12, 40
# The names of the files, how many species they have, and the places of the species in them.
NAMES = {True: "GPM_profile_clustersV7.dat", False: "GPM_profile_clustersNRV7.dat"}
N_SPECIES = {True: 5, False: 1}
SPECIES = {
    True: {"rain_water_content": 0, "cloud_water_content": 1, "snow_water_content": 2, "latent_heat": 4},
    False: {"cloud_water_content": 0},
}
ORDER = ["t_idx", "species", "cluster"]


def write(clusters: DataFrame, path: str) -> None:
    """Clusters (raining, t_idx, species, cluster, profile) as the two files of a folder. A cluster that is not given has missing values."""
    spark = clusters.sparkSession
    for raining, name in NAMES.items():
        n = N_SPECIES[raining]
        i = F.col("id")
        places = spark.range(TEMPERATURES * n * CLUSTERS).select(F.expr(f"cast(id div {n * CLUSTERS} as int)").alias("t_idx"), F.expr(f"cast(id div {CLUSTERS} % {n} as int)").alias("species"), (i % CLUSTERS).cast("int").alias("cluster"))
        own = clusters.where(F.col("raining") == raining).select(*ORDER, F.transform("profile", lambda v: v.cast("float")).alias("profile"))
        swathfiles.write_records(places.join(own, ORDER, "left").withColumn("file", F.lit(name)), "clusters", path, ORDER)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(raining, t_idx, species, cluster, profile) of the files at a path; missing layers are null."""
    rows = swathfiles.read(spark, "clusters", path)
    raining = F.col("file").endswith(NAMES[True])
    n = F.when(raining, N_SPECIES[True]).otherwise(N_SPECIES[False])
    known = rows.where(raining | F.col("file").endswith(NAMES[False])).withColumns({"raining": raining, "n": n})
    place = {"t_idx": F.expr(f"record div (n * {CLUSTERS})"), "species": F.expr(f"record div {CLUSTERS} % n"), "cluster": F.col("record") % CLUSTERS}
    return known.select("raining", *(c.cast("int").alias(k) for k, c in place.items()), F.transform("profile", null_if_missing).alias("profile"))


def of_species(clusters: DataFrame, species: str, raining: bool, t_idx: Column | None = None) -> DataFrame:
    """(t_idx, idx, centre) of one species, as `operators.profiles.compress` takes them; t_idx limits them to one temperature class."""
    if species not in SPECIES[raining]:
        raise ValueError(f"species must be one of {list(SPECIES[raining])}, not {species!r}")
    own = clusters.where((F.col("raining") == raining) & (F.col("species") == SPECIES[raining][species]))
    own = own if t_idx is None else own.where(F.col("t_idx") == t_idx)
    return own.select("t_idx", F.col("cluster").alias("idx"), F.col("profile").alias("centre"))


def decode(pixels: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pixels of result files (profile_t2m_index from 1, profile_index and profile_scale by species, ...) with the profiles of the four species
    that are reported; null where a code has none. A temperature class of clusters is one row of at most 240 profiles, as the files have no more,
    so the table is broadcast; pixels stay where they are."""
    most = (N_SPECIES[True] + N_SPECIES[False]) * CLUSTERS
    code = F.col("cluster") + F.when(F.col("raining"), 1).otherwise(1 + CLUSTERS)
    # species of raining clusters keep their place; the one species of the others is that of cloud water
    place = F.when(F.col("raining"), F.col("species")).otherwise(SPECIES[True]["cloud_water_content"])
    entry = F.struct((place * 2 * CLUSTERS + code).alias("key"), F.col("profile").alias("value"))
    packed = clusters.groupBy((F.col("t_idx") + 1).alias("profile_t2m_index")).agg(F.collect_list(entry).alias("e"))
    packed = packed.select("profile_t2m_index", F.when(F.size("e") <= most, F.map_from_entries("e")).otherwise(F.raise_error(F.lit("more clusters than a file has"))).alias("__clusters"))
    joined = pixels.join(F.broadcast(packed), "profile_t2m_index", "left")

    def profile(k: int) -> Column:
        own = F.get("profile_index", F.lit(k)).cast("int")
        found = F.try_element_at("__clusters", F.lit(k * 2 * CLUSTERS) + own)
        scale = F.get("profile_scale", F.lit(k)).cast("double")
        return F.when(own.between(1, 2 * CLUSTERS) & (scale > -999), F.transform(found, lambda v: v * scale))

    return joined.withColumns({name: profile(k) for name, k in SPECIES[True].items()}).drop("__clusters")
