"""Surface classes from land share, snow and ice cover, monthly emissivity classes and mountains.

Classes: 1 ocean, 2 sea ice, 3-7 vegetation, 8-11 snow, 12 inland water, 13-15 coast, 16 edge of sea ice, 17 rain and 18 snow over mountains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the snow cover and of the emissivity classes.
SNOW, ICE, ICE_EDGE = 2, 3, 5
WATER = 10


def without_snow(emissivity: Column, month: Column) -> Column:
    """The class of the latest month, going back from `month` (0 to 11) a year at most, that is not a snow class; 9 if there is none."""
    back = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.get(emissivity, F.pmod(month - i, F.lit(12))))
    return F.coalesce(F.get(F.filter(back, lambda e: (e < 6) | (e == WATER)), F.lit(0)), F.lit(9))


def classify(land: Column, snow: Column, emissivity: Column, month: Column) -> Column:
    """Class 1 to 16 of a cell; land is its share in percent, emissivity an array of twelve months. Ice goes before all else; snow on land takes the
    month's snow class; land without snow cover in a month of snow takes the latest class without."""
    e = F.get(emissivity, month)
    on_land = (
        F.when(snow == SNOW, F.when(e.between(6, 9), e + 2).when(e.between(1, 5) | (e == WATER), 10).when(e == 0, 8).otherwise(12))
        .when(e.between(1, 5), e + 2)
        .when(e.between(6, 9), without_snow(emissivity, month) + 2)
        .when(e == 0, 1)
        .otherwise(12)
    )
    coast = F.when(snow == SNOW, 10).when(land <= 25, 13).when(land <= 75, 14).otherwise(15)
    return F.when(snow == ICE, 2).when(snow == ICE_EDGE, 16).when(land < 0, 0).when(land <= 2, F.when(snow == SNOW, 2).otherwise(1)).when(land <= 95, coast).otherwise(on_land).cast("int")


def ice_sheets(surface: Column, lat: Column, lon: Column) -> Column:
    """Snow on Antarctica and Greenland is class 11."""
    greenland = lat.between(60, 82) & lon.between(-66, -23)
    return F.when(surface.between(8, 10) & ((lat <= -60) | greenland), 11).otherwise(surface)


def mountains(surface: Column, mountain: Column) -> Column:
    """Rain and snow over mountains have classes of their own."""
    return F.when((mountain >= 1) & surface.between(3, 7), 17).when((mountain >= 1) & surface.between(8, 11), 18).otherwise(surface)
