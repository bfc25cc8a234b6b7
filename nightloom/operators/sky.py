"""A day table of planetary longitudes, and counts against it."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Approximate mean elements at J2000 and their rates a century (semi-major axis, eccentricity,
# inclination, mean longitude, longitude of perihelion, longitude of the node), good from 1800 to 2050.
ELEMENTS = {
    "mercury": ((0.38709927, 0.20563593, 7.00497902, 252.25032350, 77.45779628, 48.33076593), (0.00000037, 0.00001906, -0.00594749, 149472.67411175, 0.16047689, -0.12534081)),
    "venus": ((0.72333566, 0.00677672, 3.39467605, 181.97909950, 131.60246718, 76.67984255), (0.00000390, -0.00004107, -0.00078890, 58517.81538729, 0.00268329, -0.27769418)),
    "earth": ((1.00000261, 0.01671123, -0.00001531, 100.46457166, 102.93768193, 0.0), (0.00000562, -0.00004392, -0.01294668, 35999.37244981, 0.32327364, 0.0)),
    "mars": ((1.52371034, 0.09339410, 1.84969142, -4.55343205, -23.94362959, 49.55953891), (0.00001847, 0.00007882, -0.00813131, 19140.30268499, 0.44441088, -0.29257343)),
    "jupiter": ((5.20288700, 0.04838624, 1.30439695, 34.39644051, 14.72847983, 100.47390909), (-0.00011607, -0.00013253, -0.00183714, 3034.74612775, 0.21252668, 0.20469106)),
    "saturn": ((9.53667594, 0.05386179, 2.48599187, 49.95424423, 92.59887831, 113.66242448), (-0.00125060, -0.00050991, 0.00193609, 1222.49362201, -0.41897216, -0.28867794)),
    "uranus": ((19.18916464, 0.04725744, 0.77263783, 313.23810451, 170.95427630, 74.01692503), (-0.00196176, -0.00004397, -0.00242939, 428.48202785, 0.40805281, 0.04240589)),
    "neptune": ((30.06992276, 0.00859048, 1.77004347, -55.12002969, 44.96476227, 131.78422574), (0.00026291, 0.00005105, 0.00035372, 218.45945325, -0.32241464, -0.00508664)),
}

#: Aspects and their separations.
ASPECTS = {"conjunction": 0.0, "sextile": 60.0, "square": 90.0, "trine": 120.0, "opposition": 180.0}


def _heliocentric(name: str, centuries: np.ndarray) -> np.ndarray:
    base, rates = ELEMENTS[name]
    a, e, i, mean, peri, node = (b + r * centuries for b, r in zip(base, rates, strict=True))
    m = np.radians((mean - peri + 180) % 360 - 180)
    anomaly = m + e * np.sin(m)
    for _ in range(8):  # Kepler's equation by Newton's method
        anomaly = anomaly - (anomaly - e * np.sin(anomaly) - m) / (1 - e * np.cos(anomaly))
    x, y = a * (np.cos(anomaly) - e), a * np.sqrt(1 - e * e) * np.sin(anomaly)
    w, o, i = np.radians(peri - node), np.radians(node), np.radians(i)
    return np.stack([(np.cos(w) * np.cos(o) - np.sin(w) * np.sin(o) * np.cos(i)) * x - (np.sin(w) * np.cos(o) + np.cos(w) * np.sin(o) * np.cos(i)) * y, (np.cos(w) * np.sin(o) + np.sin(w) * np.cos(o) * np.cos(i)) * x + (np.cos(w) * np.cos(o) * np.cos(i) - np.sin(w) * np.sin(o)) * y])


def longitudes(days: np.ndarray) -> dict[str, np.ndarray]:
    """Geocentric ecliptic longitude in degrees of the sun and seven planets at noon UTC of Unix days."""
    t = (days + 0.5 - 10957.5) / 36525.0
    earth = _heliocentric("earth", t)
    out = {"sun": np.degrees(np.arctan2(-earth[1], -earth[0])) % 360}
    for name in ELEMENTS:
        if name != "earth":
            x, y = _heliocentric(name, t) - earth
            out[name] = np.degrees(np.arctan2(y, x)) % 360
    return out


def day_table(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """day, body, longitude, sign (0-11), motion for every day; as long as the calendar and computed once."""
    days = np.arange((start - dt.date(1970, 1, 1)).days, (end - dt.date(1970, 1, 1)).days + 1)
    now, later = longitudes(days), longitudes(days + 1)
    rows = []
    for body, lon in now.items():
        speed = (later[body] - lon + 180) % 360 - 180
        motion = np.where(np.abs(speed) < 0.02, "stationary", np.where(speed < 0, "retrograde", "direct"))
        rows += [(dt.date(1970, 1, 1) + dt.timedelta(int(d)), body, float(x), int(x // 30), str(m)) for d, x, m in zip(days, lon, motion, strict=True)]
    return spark.createDataFrame(rows, "day date, body string, longitude double, sign int, motion string")


def fold(events: DataFrame, day: str, *by: str) -> DataFrame:
    """Events pre-aggregated to days and categories before they meet the sky."""
    return events.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("day"), *by).agg(F.count("*").alias("n"))


def sky_exposure(folded: DataFrame, sky: DataFrame, bin_of: Column) -> DataFrame:
    """body, bin, observed, expected, ratio: each month's events spread over its days by the sky's bins."""
    tagged = sky.select("day", F.trunc("day", "month").alias("month"), "body", bin_of.alias("bin"))
    days = tagged.groupBy("month", "body", "bin").agg(F.count("*").alias("days"))
    of = tagged.groupBy("month", "body").agg(F.count("*").alias("of"))
    daily = folded.groupBy("day").agg(F.sum("n").alias("n"))
    monthly = daily.groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("n").alias("month_n"))
    expected = days.join(of, ["month", "body"]).join(monthly, "month").groupBy("body", "bin").agg(F.sum(F.col("month_n") * F.col("days") / F.col("of")).alias("expected"))
    observed = tagged.join(daily, "day").groupBy("body", "bin").agg(F.sum("n").alias("observed"))
    return expected.join(observed, ["body", "bin"], "left").select("body", "bin", F.coalesce("observed", F.lit(0)).alias("observed"), "expected", (F.coalesce("observed", F.lit(0)) / F.col("expected")).alias("ratio"))


def aspects(sky: DataFrame, orb: float = 8.0) -> DataFrame:
    """day, pair, aspect of pairs of bodies within the orb of an aspect, the nearest one."""
    a, b = (sky.select("day", F.col("body").alias(f"{p}_body"), F.col("longitude").alias(f"{p}_lon")) for p in "ab")
    apart = F.abs(F.pmod(F.col("b_lon") - F.col("a_lon") + 180, F.lit(360.0)) - 180)
    near = F.array_sort(F.array(*[F.struct(F.abs(apart - s).alias("off"), F.lit(n).alias("aspect")) for n, s in ASPECTS.items()]))[0]
    pairs = a.join(b, "day").where("a_body < b_body").select("day", F.concat_ws("-", "a_body", "b_body").alias("pair"), near.alias("n"))
    return pairs.where(F.col("n.off") <= orb).select("day", "pair", "n.aspect")
