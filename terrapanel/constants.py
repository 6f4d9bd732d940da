"""Fixed values. They must equal the published or agreed figures for results to agree."""

# Physics, FAO-56 conventions unless stated.
LATENT_HEAT_MJ_KG = 2.45
CP_MJ_KG_K = 1.013e-3
SECONDS_PER_DAY = 86400.0
GSC_MJ_M2_MIN = 0.0820
STEFAN_BOLTZMANN = 4.903e-9
R_SPECIFIC_AIR = 0.287
EARTH_RADIUS_KM = 6371.0088
MERCATOR_RADIUS_M = 6378137.0

# Length of the months of a 365-day year; the mid-month day of year follows from it.
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]

# Daily station records: elements kept, and those stored in tenths of a unit.
STATION_ELEMENTS = ["PRCP", "TMAX", "TMIN", "TAVG", "SNOW", "SNWD"]
STATION_TENTHS = ["PRCP", "TMAX", "TMIN", "TAVG"]

# Closed-forest classes of the ecosystem map and the species group of each (37 has none).
CLOSED_FOREST_CLASSES = [31, 32, 33, 34, 35, 36, 37]
GROUP_OF_CLASS = {
    31: "mesic_diffuse_porous_broadleaf",
    32: "ring_porous_oak",
    33: "ring_porous_oak",
    34: "ring_porous_oak",
    35: "ring_porous_oak",
    36: "pine",
}

# Climate windows of the scenario runs.
BASELINE_WINDOW = (2015, 2019)
HORIZON_WINDOWS = {2050: (2048, 2052), 2080: (2078, 2082), 2100: (2096, 2100)}
PERIOD_OF_HORIZON = {2050: "2041-2070", 2080: "2071-2100", 2100: "2071-2100"}

# Treeline thresholds (Koerner and Paulsen 2004), midpoints of the published ranges.
TREELINE_GST_C = 6.45
TREELINE_LGS_DAYS = 92.0

# Saxton and Rawls (2006) Table 1: intercept and factors of
# [sand, clay, om, sand*om, clay*om, sand*clay], then the second-stage polynomial in t.
SAXTON_RAWLS = {
    "theta_1500": ([0.031, -0.024, 0.487, 0.006, 0.005, -0.013, 0.068], (-0.02, 1.14, 0.0)),
    "theta_33": ([0.299, -0.251, 0.195, 0.011, 0.006, -0.027, 0.452], (-0.015, 0.626, 1.283)),
    "theta_s_33": ([0.078, 0.278, 0.034, 0.022, -0.018, -0.027, -0.584], (-0.107, 1.636, 0.0)),
}
SATURATION_SAND = -0.097
SATURATION_SHIFT = 0.043
VAN_BEMMELEN = 1.724
BULK_DENSITY_MG_M3 = 1.3

# Quality-flag bits that mark a pixel as unusable, and reflectance scaling, per product family.
QA_BITS = {"hls": [1, 2, 3, 4], "landsat": [1, 2, 3, 4, 5]}
REFLECTANCE_SCALE = {"hls": (0.0001, 0.0), "landsat": (0.0000275, -0.2)}
