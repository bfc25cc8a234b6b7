"""Points near points on the space-filling curve."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nightloom.functions.geo import LEVEL
from nightloom.operators.nearby import _spread, disc_ranges, region_ranges, within_distance, within_regions


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def code(lat, lon):
    n = 1 << LEVEL
    lon = (lon + 180) % 360 - 180
    iy, ix = min(int((lat + 90) / 180 * n), n - 1), min(int((lon + 180) / 360 * n), n - 1)
    return int((_spread(np.array([iy])) << 1 | _spread(np.array([ix])))[0])


@settings(max_examples=300, deadline=None)
@given(st.floats(-90, 90), st.floats(-180, 179.999), st.floats(0.1, 400), st.floats(0, 1), st.floats(0, 360))
def test_ranges_cover_the_disc(lat, lon, radius, share, angle):
    far, b, p = radius * share / 6371.0088, math.radians(angle), math.radians(lat)
    lat2 = math.degrees(math.asin(max(-1, min(1, math.sin(p) * math.cos(far) + math.cos(p) * math.sin(far) * math.cos(b)))))
    lon2 = lon + math.degrees(math.atan2(math.sin(b) * math.sin(far) * math.cos(p), math.cos(far) - math.sin(p) * math.sin(math.radians(lat2))))
    if km(lat, lon, lat2, lon2) <= radius:
        at = code(lat2, lon2)
        assert any(lo <= at <= hi for lo, hi in disc_ranges(lat, lon, radius))


def test_against_brute_force(spark):
    rng = random.Random(3)
    spots = [(0, 0), (89.97, 10), (-89.99, 0), (51, 179.98), (51, -179.99), (33.5, -112)]
    points = [(f"p{i}", min(90.0, max(-90.0, a + rng.gauss(0, 0.05))), b + rng.gauss(0, 0.08)) for i in range(400) for a, b in [rng.choice(spots)]]
    points += [("wrap", 51.0, 539.98), ("nan", float("nan"), 1.0), ("null", None, 1.0), ("far", 95.0, 1.0), ("inf", 1.0, float("inf")), (None, 0.0, 0.0), ("p0", points[0][1], points[0][2])]
    sites = [(f"s{i % 25}", min(90.0, max(-90.0, a + rng.gauss(0, 0.05))), b + rng.gauss(0, 0.08)) for i in range(60) for a, b in [rng.choice(spots)]] + [("bad", None, None), (None, 0.0, 0.0)]
    fine = lambda x: x[0] and x[1] is not None and not math.isnan(x[1]) and abs(x[1]) <= 90 and math.isfinite(x[2])
    expected = {(p[0], s[0]) for p in points if fine(p) for s in sites if fine(s) and km(p[1], p[2], s[1], s[2]) <= 5}
    left = spark.createDataFrame([(*p, "x", 1) for p in points], "id string, lat double, lon double, site string, prefix int")
    right = spark.createDataFrame([(*s, 1) for s in sites], "site string, lat double, lon double, code int")
    assert {tuple(r) for r in within_distance(left, right, 5.0).collect()} == expected
    assert len(expected) > 50


@pytest.mark.parametrize("side", ["left", "right"])
def test_empty(spark, side):
    one = spark.createDataFrame([("a", 0.0, 0.0)], "id string, lat double, lon double")
    left, right = (one.limit(0), one) if side == "left" else (one, one.limit(0))
    assert within_distance(left, right.withColumnRenamed("id", "site"), 5.0).count() == 0


def ray(lat, lon, ring):
    hit = False
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        hit ^= y1 != y2 and (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) * ((x2 - x1) / (y2 - y1))
    return hit


def star(rng, lat, lon, reach):
    """A simple ring with dents around a position."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 12)))
    return [(max(-89.0, min(89.0, lat + r * math.sin(t))), lon + r * math.cos(t)) for t in turns for r in [reach * rng.uniform(0.2, 1)]]


def test_region_ranges_hold_every_position():
    rng = random.Random(12)
    for _ in range(60):
        ring = star(rng, rng.uniform(-60, 60), rng.uniform(-180, 180), rng.choice([0.01, 1, 30, 100]))
        ranges = region_ranges(np.array(ring))
        assert len(ranges) < 400
        for _ in range(60):
            (a, b), k = rng.choice(ring), rng.uniform(0, 2)
            lat, lon = max(-90.0, min(90.0, ring[0][0] + k * (a - ring[0][0]))), ring[0][1] + k * (b - ring[0][1])
            at, held = code(lat, lon), any(ray(lat, lon + t, ring) for t in (-360, 0, 360))
            found = [whole for lo, hi, whole in ranges if lo <= at <= hi]
            assert bool(found) or not held
            assert held or not any(found)


def test_regions_against_brute_force(spark):
    rng = random.Random(7)
    rings = [(f"r{i % 9}", star(rng, rng.uniform(-60, 60), rng.choice([-175.0, 178.0, 20.0]), rng.choice([0.05, 3, 40]))) for i in range(14)]
    points = [(f"p{i}", *(min(90.0, max(-90.0, x + rng.gauss(0, s))) if k == 0 else x + rng.gauss(0, s) for k, x in enumerate(rng.choice(rng.choice(rings)[1])))) for i in range(500) for s in [rng.choice([0.02, 2.0])]]
    points += [("nan", float("nan"), 1.0), ("null", None, 1.0), (None, 0.0, 0.0), ("p0", points[0][1], points[0][2])]
    wrap = lambda x: (x + 180) % 360 - 180
    expected = {(p, r) for p, lat, lon in points if p and lat is not None and lat == lat for r, ring in rings if any(ray(lat, wrap(lon) + t, ring) for t in (-360, 0, 360))}
    kind = "region string, ring array<struct<lat:double,lon:double>>, lat double"
    regions = spark.createDataFrame([(r, ring, 1.0) for r, ring in rings] + [("thin", [(0.0, 0.0), (1.0, 1.0)], 1.0), (None, rings[0][1], 1.0), ("null", None, 1.0)], kind)
    df = spark.createDataFrame([(*p, "x") for p in points], "id string, lat double, lon double, region string")
    assert {tuple(r) for r in within_regions(df, regions).collect()} == expected and len(expected) > 100
    assert within_regions(df.limit(0), regions).count() == within_regions(df, regions.limit(0)).count() == 0
