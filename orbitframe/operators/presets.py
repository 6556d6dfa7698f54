"""Bundles of statistics by kind of data: training scenes, a-priori bins, observations, retrievals, combined products.

A bundle is one scan of its table for all statistics of pixels, as grouping sets, and one for the entries of each column of arrays. Tasks add cells up
before anything is shuffled, and what is shuffled is bounded by the number of bins, whatever the number of rows. The layers of a profile that share a
cell are added up in their row.

Rows have surface_type, airmass_type, latitude, longitude, scan_time, pixel, t2m, tcwv, tb and the targets, as far as a bundle needs them. A target is
a number or, for a profile, an array of layers. In a-priori bins of sensors with several viewing angles tb is an array of channels for each angle,
and the precipitation targets are arrays by angle; over surfaces of `SINGLE_ANGLE` they hold one entry, whose angle is pixel_position - 1.

The result is (statistic, target, k0 ... k4, n, total, mean): the keys of each statistic are listed at its function, shorter ones end in nulls, and
histograms have no total. Values at or below -999, NaN and null count nowhere. Tables of several runs add up with `stats.merge`.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from orbitframe.functions.bins import log_bin, uniform_bin
from orbitframe.functions.clean import null_if_missing
from orbitframe.operators import stats

KEYS = 5
SAVED = f"target string, {', '.join(f'k{i} int' for i in range(KEYS))}, n bigint, total double, statistic string"

# The targets of a retrieval, those that viewing angles change, and the surface classes with one angle a record.
TARGETS = [
    "surface_precip",
    "convective_precip",
    "cloud_water_content",
    "rain_water_content",
    "snow_water_content",
    "latent_heat",
    "ice_water_path",
    "rain_water_path",
    "cloud_water_path",
]
BY_ANGLE = ["surface_precip", "convective_precip"]
SINGLE_ANGLE = [2, 8, 9, 10, 11, 16]
LOWEST = {"latent_heat": -500.0}
HIGHEST = 500.0

KINDS = ("training_1d", "training_3d", "bin", "observations", "retrieval", "combined")


@dataclass(frozen=True)
class Statistic:
    """A name, the target it is of, its keys (columns, or numbers that are the same everywhere), how many values a row has, and their sum. A row counts
    where no key is null and it has values. With `items`, a column of arrays, it is of the entries __v of these, at the places __i, and not of rows."""

    name: str
    target: str | None
    keys: tuple[Column | int, ...]
    n: Column | None = None
    total: Column | None = None
    items: str | None = None


def _grouped(df: DataFrame, statistics: dict[int, Statistic]) -> DataFrame:
    """(code, k0 ... k4, n, total) of statistics of the rows of df: one aggregation by all their keys as grouping sets, all of it in generated code."""
    keys, measures, made = {}, {}, {}

    def named(where: dict[str, Column], c: Column, kind: str, prefix: str) -> str:
        if str(c) not in made:
            made[str(c)] = f"__{prefix}{len(made)}"
            where[made[str(c)]] = c.cast(kind)
        return made[str(c)]

    sets: dict[tuple[str, ...], list[tuple[int, list, str, str | None]]] = {}
    for code, s in statistics.items():
        n = F.lit(1) if s.n is None else s.n
        total = None if s.total is None else named(measures, F.when(n > 0, s.total), "double", "m")
        own = [k if isinstance(k, int) else named(keys, k, "int", "k") for k in s.keys]
        sets.setdefault(tuple(dict.fromkeys(k for k in own if isinstance(k, str))), []).append((code, own, named(measures, n, "long", "m"), total))
    sums = df.select(*(c.alias(k) for k, c in {**keys, **measures}.items())).groupingSets([[F.col(k) for k in x] for x in sets], *keys)
    sums = sums.agg(F.grouping_id().alias("__set"), *(F.sum(m).alias(m) for m in measures))

    cells = F.lit(None)
    for own, found in sets.items():
        number = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
        each = []
        for code, by, n, total in found:
            by = [*(F.lit(k) if isinstance(k, int) else F.col(k) for k in by), *[F.lit(None)] * (KEYS - len(by))]
            each.append(F.struct(F.lit(code).alias("code"), *(k.cast("int").alias(f"k{i}") for i, k in enumerate(by)), F.col(n).alias("n"), (F.lit(None) if total is None else F.col(total)).cast("double").alias("total")))
        there = functools.reduce(operator.and_, (F.col(k).isNotNull() for k in own))
        cells = F.when((F.col("__set") == number) & there, F.array(*each)).otherwise(cells)
    return sums.select(cells.alias("cells")).select(F.explode("cells").alias("c")).select("c.*").where("n > 0")


def collect(df: DataFrame, statistics: list[Statistic]) -> DataFrame:
    """All statistics, as (statistic, target, k0 ... k4, n, total, mean): those of rows in one scan, those of a column of arrays in one scan of it."""
    kinds: dict[str | None, dict[int, Statistic]] = {}
    for code, s in enumerate(statistics):
        kinds.setdefault(s.items, {})[code] = s
    parts = [_grouped(df if items is None else df.select("*", F.posexplode(items).alias("__i", "__v")), own) for items, own in kinds.items()]
    added = functools.reduce(DataFrame.unionByName, parts)
    of = lambda values: F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.col("code"))
    names = of([s.name for s in statistics]).alias("statistic"), of([s.target for s in statistics]).alias("target")
    return stats.finish(added.select(*names, *(f"k{i}" for i in range(KEYS)), "n", "total"))


class Parts:
    """The statistics of a table's columns."""

    def __init__(self, df: DataFrame, angles: list[float] | None, centre: tuple[int, int]):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.targets = [t for t in TARGETS if t in df.columns]
        self.angles, self.centre = angles, centre
        within = lambda c, low, high: F.when(F.col(c).between(low, high), F.col(c))
        made = {"surface": within("surface_type", 1, 18), "airmass": within("airmass_type", 0, 3), "t2m": uniform_bin(F.col("t2m"), 239.5, 339.5, 100), "tcwv": uniform_bin(F.col("tcwv"), -0.5, 99.5, 100)}
        if {"latitude", "longitude"} <= set(self.types):
            made |= {"lat": uniform_bin(F.col("latitude"), -90.0, 90.0, 180), "lat5": uniform_bin(F.col("latitude"), -90.0, 90.0, 36), "lon5": uniform_bin(F.col("longitude"), -180.0, 180.0, 72)}
        # a profile's valid layers, all of them and only if none is missing, are found once for all its statistics
        for t in self.targets:
            made |= {f"v_{t}": self._clean(t, False), f"w_{t}": self._clean(t, True)} if self.profile(t) else {f"v_{t}": null_if_missing(F.col(t))}
        if isinstance(self.types.get("tb"), ArrayType) and isinstance(self.types["tb"].elementType, ArrayType):
            made["tb_entries"] = F.flatten(F.transform("tb", lambda row, i: F.transform(row, lambda t, c: F.struct(i.alias("i"), c.alias("c"), t.alias("t")))))
        self.df = df.withColumns({f"__{k}": v for k, v in made.items()})
        self.surface, self.airmass, self.t2m_bin, self.tcwv_bin, self.lat_bin = (F.col(f"__{k}") for k in ("surface", "airmass", "t2m", "tcwv", "lat"))

    def profile(self, target: str) -> bool:
        return isinstance(self.types[target], ArrayType)

    def _clean(self, target: str, whole: bool) -> Column:
        valid = F.array_compact(F.transform(target, null_if_missing))
        return F.when(F.size(valid) == F.size(target), valid) if whole else valid

    def values(self, target: str, whole: bool = False) -> Column:
        """The valid value of a target, or the valid layers of a profile; whole: none of them unless all are valid."""
        return F.col(f"__w_{target}" if whole and self.profile(target) else f"__v_{target}")

    def target_bin(self, target: str, value: Column) -> Column:
        return uniform_bin(value, LOWEST.get(target, 0.0), HIGHEST, 200)

    def tb(self, joint: bool, where: Column | None = None) -> list[Statistic]:
        """tb: (surface, channel, angle, bin); tb_tcwv: (surface, channel, angle, bin of water vapour, bin). The angle is 0 without angles."""
        by, bin_ = (self.surface, F.col("__i"), self.viewed()), uniform_bin(F.col("__v"), 0.0, 400.0, 400)
        out = [Statistic("tb", None, (*by, bin_), where, items="tb")]
        if joint:
            out.append(Statistic("tb_tcwv", None, (*by, self.tcwv_bin, bin_), where, items="tb"))
        return out

    def viewed(self) -> Column | int:
        """The number of the nearest of the viewing angles, which descend, for the absolute incidence angle; null beyond half a step outside them."""
        if not self.angles:
            return 0
        middle = [(a + b) / 2 for a, b in zip(self.angles, self.angles[1:], strict=False)]
        edges = [2 * middle[0] - middle[1], *middle, 2 * middle[-1] - middle[-2]]
        eia, out = F.abs("earth_incidence_angle"), F.lit(None).cast("int")
        for i, (high, low) in enumerate(zip(edges, edges[1:], strict=False)):
            out = F.when((eia >= low) & (eia < high), i).otherwise(out)
        return out

    def tb_by_angle(self) -> list[Statistic]:
        """tb: (surface, channel, angle, bin) of arrays by angle."""
        v = F.col("__v")
        return [Statistic("tb", None, (self.surface, v["c"], self.place(v["i"]), uniform_bin(v["t"], 0.0, 400.0, 400)), items="__tb_entries")]

    def place(self, i: Column) -> Column:
        n = len(self.angles)
        return F.when(F.col("surface_type").isin(SINGLE_ANGLE), F.when(F.col("pixel_position").between(1, n), F.col("pixel_position") - 1)).otherwise(F.when(i < n, i))

    def histograms(self, whole: bool = False, by_angle: bool = False) -> list[Statistic]:
        """histogram: (surface, angle, bin) of each target."""
        out = []
        for t in self.targets:
            if by_angle and t in BY_ANGLE:
                out.append(Statistic("histogram", t, (self.surface, self.place(F.col("__i")), self.target_bin(t, null_if_missing(F.col("__v")))), items=t))
            elif self.profile(t):
                out.append(Statistic("histogram", t, (self.surface, 0, self.target_bin(t, F.col("__v"))), items=f"__w_{t}" if whole else f"__v_{t}"))
            else:
                out.append(Statistic("histogram", t, (self.surface, 0, self.target_bin(t, self.values(t)))))
        return out

    def means(self, name: str, *keys: Column, whole: bool = False, where: Column | None = None) -> list[Statistic]:
        """Number and sum of each target's values by keys."""
        out = []
        for t in self.targets:
            v = self.values(t, whole)
            n, total = (F.size(v), F.aggregate(v, F.lit(0.0), lambda a, x: a + x)) if self.profile(t) else (F.when(v.isNotNull(), 1), v)
            n = n if where is None else F.when(where, n)
            out.append(Statistic(name, t, keys, n, total))
        return out

    def ancillary(self, t2m_bin: Column | None = None, where: Column | None = None) -> list[Statistic]:
        """t2m, tcwv: (surface, bin); surface: (surface); airmass: (airmass). where limits the first two."""
        n = F.lit(1) if where is None else F.when(where, 1)
        t2m_bin = self.t2m_bin if t2m_bin is None else t2m_bin
        return [
            Statistic("t2m", None, (self.surface, t2m_bin), n),
            Statistic("tcwv", None, (self.surface, self.tcwv_bin), n),
            Statistic("surface", None, (self.surface,)),
            Statistic("airmass", None, (self.airmass,)),
        ]

    def times(self) -> list[Statistic]:
        """latitude: (degree); local_time: (hour); latitude_local_time: (degree, hour), in solar time."""
        hour = F.hour(F.timestamp_add("SECOND", (F.col("longitude") * 240).cast("int"), F.col("scan_time")))
        return [Statistic("latitude", None, (self.lat_bin,)), Statistic("local_time", None, (hour,)), Statistic("latitude_local_time", None, (self.lat_bin, hour))]

    def rain(self) -> tuple[Column, Column]:
        """The surface rate where it is valid, and its bin."""
        v = null_if_missing(F.col("surface_precip"))
        v = F.when(v >= 0, v)
        return v, log_bin(v, 0.01, 10**2.5, 200)

    def zonal(self) -> list[Statistic]:
        """zonal: (degree) of each target; zonal_histogram: (degree, bin) of surface rates."""
        return [*self.means("zonal", self.lat_bin), Statistic("zonal_histogram", "surface_precip", (self.lat_bin, self.rain()[1]))]

    def cells5(self, step: float = 5.0) -> tuple[Column, Column]:
        if step == 5.0:
            return F.col("__lat5"), F.col("__lon5")
        return uniform_bin(F.col("latitude"), -90.0, 90.0, round(180 / step)), uniform_bin(F.col("longitude"), -180.0, 180.0, round(360 / step))

    def over_globe(self) -> list[Statistic]:
        """global: (latitude, longitude) of each target in cells of five degrees; global_histogram: (latitude, longitude, bin) of surface rates."""
        return [*self.means("global", *self.cells5()), Statistic("global_histogram", "surface_precip", (*self.cells5(), self.rain()[1]))]


def statistics(p: Parts, kind: str, resolution: float = 5.0, monthly: bool = False) -> list[Statistic]:
    """The statistics of a kind."""
    if kind.startswith("training"):  # scenes and single pixels differ in their files, not in their rows
        return [*p.tb(joint=True), *p.histograms(), *p.means("by_tcwv", p.surface, p.tcwv_bin), *p.ancillary(), *p.times(), *p.zonal(), *p.over_globe()]
    if kind == "bin":
        tb = p.tb_by_angle() if p.angles else p.tb(joint=False)
        return [*tb, *p.histograms(by_angle=bool(p.angles)), *p.means("by_t2m", p.surface, p.t2m_bin), *p.means("by_tcwv", p.surface, p.tcwv_bin), *p.ancillary()]
    if kind == "observations":
        near = F.col("latitude").between(-65.5, 65.5)
        return [*p.tb(joint=True, where=F.when(near, 1)), *p.ancillary(uniform_bin(F.col("t2m"), 240.0, 330.0, 200), near), *p.times()]
    if kind == "retrieval":
        middle = F.col("pixel").between(p.centre[0], p.centre[1] - 1)
        rate = F.coalesce(null_if_missing(F.col("surface_precip")), F.lit(0.0))
        position = Statistic("scan_position", "surface_precip", (F.col("pixel"),), total=rate)
        by = [*p.means("by_t2m", p.surface, p.t2m_bin, whole=True), *p.means("by_tcwv", p.surface, p.tcwv_bin, whole=True), *p.means("by_tcwv_centre", p.surface, p.tcwv_bin, whole=True, where=middle)]
        return [*p.histograms(whole=True), *by, *p.zonal(), *p.over_globe(), position]
    month = [F.month("scan_time")] if monthly else []
    rate, bin_ = p.rain()
    where = [*month, *p.cells5(resolution)]
    return [Statistic("global", "surface_precip", tuple(where), F.when(rate.isNotNull(), 1), rate), Statistic("global_histogram", "surface_precip", (*where, bin_))]


def preset(df: DataFrame, kind: str, angles: list[float] | None = None, centre: tuple[int, int] = (98, 123), **options) -> DataFrame:
    """The bundle of a kind, in one scan. angles: a sensor's viewing angles, descending; centre: the pixels [a, b) of the middle of the swath;
    resolution and monthly: the cells of combined products, which with months have the month (1 to 12) as first key."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    p = Parts(df, angles, centre)
    return collect(p.df, statistics(p, kind, **options))


def save(stat: DataFrame, path: str, mode: str = "error") -> None:
    """A folder for each statistic, so that one is read without the others."""
    stat.drop("mean").hint("rebalance", "statistic").write.partitionBy("statistic").mode(mode).parquet(path)


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """The statistics saved at these paths, added up, with their means."""
    saved = [spark.read.schema(SAVED).parquet(p) for p in paths]  # a run without rows has no file to take it from
    return stats.finish(stats.merge(*saved)).select("statistic", "target", *(f"k{i}" for i in range(KEYS)), "n", "total", "mean")
