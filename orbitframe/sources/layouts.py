"""Record layouts of the binary swath formats, for sources/records.py and sources/granules.py. Numbers are little-endian.

A layout is a list of "name kind [shape]"; sizes such as channels and angles depend on the sensor."""

from __future__ import annotations

import numpy as np

# Channels in conical records, layers of a profile, species of a retrieval, surface classes whose records are not by angle.
CHANNELS, LAYERS, SPECIES = 15, 28, 5
SINGLE_ANGLE = (2, 8, 9, 10, 11, 16)
# Places of a sensor's channels among the 15.
CHANNEL_INDICES = {
    "TMIPR": [0, 1, 2, 3, 4, 6, 7, 8, 9],
    "TMIPO": [0, 1, 2, 3, 4, 6, 7, 8, 9],
    "SSMI": [2, 3, 4, 6, 7, 8, 9],
    "SSMIS": [2, 3, 4, 6, 7, 8, 9, 11, 12, 13, 14],
    "AMSR2": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    "AMSRE": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
}


def layout(fields: str) -> np.dtype:
    """The type of a record from 'name kind shape, ...'; a shape is a number or numbers joined by x."""
    out = []
    for field in fields.replace("\n", " ").split(","):
        name, kind, *shape = field.split()
        kind = kind if kind.startswith("S") else "<" + kind
        out.append((name, kind, tuple(int(n) for n in shape[0].split("x"))) if shape else (name, kind))
    return np.dtype(out)


# The fields of each format in their order.
def preprocessor_header(channels: int = CHANNELS) -> np.dtype:
    return layout(
        f"""satellite S12, sensor S12, preprocessor S12, profile_database_file S128, radiometer_file S128, calibration_file S128, granule_number i4,
        number_of_scans i4, number_of_pixels i4, n_channels i4, frequencies f4 {channels}, comment S40"""
    )


PREPROCESSOR_SCAN = layout("scan_date i2 6, scan_latitude f4, scan_longitude f4, scan_altitude f4")


def preprocessor_pixel(channels: int = CHANNELS, conical: bool = True) -> np.dtype:
    angle = f" {channels}" if conical else ""
    return layout(
        f"""latitude f4, longitude f4, brightness_temperatures f4 {channels}, earth_incidence_angle f4{angle}, wet_bulb_temperature f4, lapse_rate f4,
        total_column_water_vapor f4, surface_temperature f4, two_meter_temperature f4, quality_flag i4, sunglint_angle i1, surface_type i1, airmass_type i2"""
    )


def bin_header(channels: int = CHANNELS, angles: int = 1, conical: bool = True) -> np.dtype:
    return layout(f"satellite_code S5, sensor S5, frequencies f4 {channels}, nominal_eia f4 {channels if conical else angles}")


def bin_record(surface: int, channels: int = CHANNELS, angles: int = 1, conical: bool = True) -> np.dtype:
    """Conical: one angle. Cross-track: one with its pixel position over sea ice and snow, else all angles."""
    tail = f"""rain_water_path f4, cloud_water_path f4, ice_water_path f4, total_column_water_vapor f4, two_meter_temperature f4,
        rain_water_content f4 {LAYERS}, cloud_water_content f4 {LAYERS}, snow_water_content f4 {LAYERS}, latent_heat f4 {LAYERS}"""
    head = "dataset_number i4, latitude f4, longitude f4, scan_time i4 6"
    if conical:
        return layout(f"{head}, surface_precip f4, convective_precip f4, brightness_temperatures f4 {CHANNELS}, delta_tb f4 {CHANNELS}, {tail}")
    if surface in SINGLE_ANGLE:
        return layout(f"{head}, surface_precip f4, convective_precip f4, pixel_position i4, brightness_temperatures f4 {channels}, {tail}")
    return layout(f"{head}, surface_precip f4 {angles}, convective_precip f4 {angles}, brightness_temperatures f4 {angles}x{channels}, {tail}")


def sim_header(channels: int = CHANNELS, angles: int = 1, conical: bool = True) -> np.dtype:
    last = f"nominal_eia f4 {CHANNELS}" if conical else f"viewing_angles f4 {angles}"
    return layout(f"satellite_code S5, sensor S5, frequencies f4 {CHANNELS if conical else channels}, {last}, start_pixel i4, end_pixel i4, start_scan i4, end_scan i4")


def sim_record(channels: int = CHANNELS, angles: int = 1, conical: bool = True) -> np.dtype:
    profiles = f"rain_water_content f4 {LAYERS}, snow_water_content f4 {LAYERS}, cloud_water_content f4 {LAYERS}, latent_heat f4 {LAYERS}"
    place = "latitude f4, longitude f4, elevation f4, scan_time i4 6, surface_type i4"
    if conical:
        return layout(
            f"""pixel_index i4, scan_index i4, data_source f4, {place}, surface_precip_combined f4, surface_precip_mirs f4, surface_precip f4,
            convective_precip f4, emissivity f4 15, {profiles}, tbs_observed f4 15, tbs_simulated f4 15, d_tbs f4 15, tbs_bias f4 15"""
        )
    precip = ", ".join(f"{k} f4 {angles}" for k in ("surface_precip_source", "surface_precip_mirs", "surface_precip_cmb", "surface_precip", "convective_precip"))
    return layout(f"pixel_index i4, scan_index i4, {place}, {precip}, emissivity f4 {angles}x{channels}, {profiles}, tbs_simulated f4 {angles}x{channels}, tbs_bias f4 {channels}")


def mrms_record(kind: str, channels: int = CHANNELS) -> np.dtype:
    """kind: conical, constellation, xtrack or snow."""
    rates = "surface_precip f4, surface_rain f4, convective_rain f4, stratiform_rain f4, snow f4"
    quality = "quality_index f4, gauge_fraction f4, standard_deviation f4, n_stratiform i4, n_convective i4, n_rain i4, n_snow i4"
    if kind == "conical":
        return layout(f"latitude f4, longitude f4, scan_time i4 5, quality_flag f4, {rates}, {quality}, fraction_missing f4, brightness_temperatures f4 15")
    glint, snow, counts = ("sun_glint i4, ", ", snow3 f4, snow4 f4", ", n_snow3 i4, n_snow4 i4") if kind == "snow" else ("", "", "")
    return layout(
        f"""datasetnum i4, latitude f4, longitude f4, orbitnum i4, n_pixels i4, n_scans i4, scan_time i4 5, skin_temperature i4, total_column_water_vapor i4,
        {glint}surface_type i4, quality_flag f4, two_meter_temperature f4, wet_bulb_temperature f4, lapse_rate f4, {rates}{snow}, {quality}{counts}, fraction_missing f4,
        brightness_temperatures f4 {15 if kind == 'constellation' else channels}"""
    )


def retrieval_record(variant: str = "plain") -> np.dtype:
    """variant: plain, profiles or sensitivity."""
    more = "surface_precip_1 f4, surface_precip_2 f4, dsurface_precip_dy f4 15, " if variant == "sensitivity" else ""
    last = f", profiles f4 {4 * LAYERS}" if variant == "profiles" else ""
    return layout(
        f"""pixel_status i1, quality_flag i1, l1c_quality_flag i1, surface_type i1, total_column_water_vapor i1, pop i1, two_meter_temperature i2, airmass_type i2,
        sunglint_angle i1, precip_flag i1, latitude f4, longitude f4, surface_precip f4, {more}frozen_precip f4, convective_precip f4, rain_water_path f4, cloud_water_path f4,
        ice_water_path f4, most_likely_precip f4, precip_1st_tercile f4, precip_2nd_tercile f4, profile_t2m_index i2, profile_index i2 {SPECIES}, profile_scale f4 {SPECIES}{last}"""
    )


RETRIEVAL_SCAN = layout("scan_latitude f4, scan_longitude f4, scan_altitude f4, scan_date i2 7, spare i2")
