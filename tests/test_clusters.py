"""Profile cluster files: sizes, order, round trips, and each cluster as the nearest of its class."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import profiles
from orbitframe.sources import clusters


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clusters") / "files")
    r = np.random.default_rng(2)
    rows = [(raining, t, s, c, r.gamma(1.0, 1.0, 28).tolist()) for raining in (True, False) for t in range(12) for s in range(5 if raining else 1) for c in range(40) if (t, s, c) != (3, 0, 7)]
    clusters.write(spark.createDataFrame(rows, "raining boolean, t_idx int, species int, cluster int, profile array<double>"), path)
    return path, {x[:4]: x[4] for x in rows}


def test_files_are_plain_arrays(folder):
    path, rows = folder
    rain = np.fromfile(f"{path}/GPM_profile_clustersV7.dat", "<f4").reshape(12, 5, 40, 28)
    rest = np.fromfile(f"{path}/GPM_profile_clustersNRV7.dat", "<f4").reshape(12, 1, 40, 28)
    assert np.allclose(rain[11, 4, 39], rows[True, 11, 4, 39]) and np.allclose(rest[5, 0, 2], rows[False, 5, 0, 2])
    assert np.all(rain[3, 0, 7] == np.float32(-9999.9))


def test_round_trip_and_nearest(spark, folder):
    path, rows = folder
    back = clusters.read(spark, path)
    got = {tuple(r[:4]): r[4] for r in back.collect()}
    assert len(got) == 12 * 6 * 40 and got[True, 3, 0, 7] == [None] * 28
    assert all(np.allclose(got[k], v) for k, v in rows.items())
    cloud = clusters.of_species(back, "cloud_water_content", True)
    centres = cloud.withColumn("centre", profiles.normalised(F.col("centre")))
    own = profiles.compress(cloud.withColumnRenamed("idx", "cluster"), centres, "t_idx", "centre").collect()
    assert len(own) == 480 and all(r.idx == r.cluster and r.mse < 1e-12 for r in own)
    with pytest.raises(ValueError, match="species must be"):
        clusters.of_species(back, "snow_water_content", False)


def test_codes_without_profiles(spark, folder):
    path, rows = folder
    pixels = spark.createDataFrame(
        [(0, 1, [1, 41, 0, 1, -99], [2.0] * 5), (1, 4, [8, 80, 81, 1, 40], [1.0, 3.0, 1.0, 1.0, -9999.9]), (2, 99, [1] * 5, [1.0] * 5), (3, None, None, None)],
        "id int, profile_t2m_index smallint, profile_index array<smallint>, profile_scale array<float>",
    )
    got = {r["id"]: r for r in clusters.decode(pixels, clusters.read(spark, path)).collect()}
    assert np.allclose(got[0].rain_water_content, 2 * np.array(rows[True, 0, 0, 0])) and np.allclose(got[0].cloud_water_content, 2 * np.array(rows[False, 0, 0, 0]))
    assert got[0].snow_water_content is None and got[0].latent_heat is None
    assert got[1].rain_water_content == [None] * 28 and np.allclose(got[1].cloud_water_content, 3 * np.array(rows[False, 3, 0, 39]))
    assert got[1].snow_water_content is None and got[1].latent_heat is None
    assert all(got[i][c] is None for i in (2, 3) for c in ("rain_water_content", "latent_heat"))
