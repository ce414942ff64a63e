"""Gridded files written by a small encoder here, read back."""

import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillet.sources import grib


def sign(v, n):
    return (abs(v) | (1 << (8 * n - 1) if v < 0 else 0)).to_bytes(n, "big")


def section(number, body):
    return (len(body) + 5).to_bytes(4, "big") + bytes([number]) + body


def packed(v, bits):
    return np.packbits(((v[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8)).tobytes() if bits else b""


def message(grid, lat1, lon1, step, member=None, interval=None, bits=12, decimal=1, binary=-2, mode=0, packing=0, again=None):
    """grid (rows, columns) in the order of its scan, a degree apart; nan: missing. ``again``: further grids as fields of the same message."""
    nj, ni = grid.shape
    lat2, lon2 = lat1 + (nj - 1) * (1 if mode & 0x40 else -1), lon1 + (ni - 1) * (-1 if mode & 0x80 else 1)
    micro = lambda d: sign(round(d * 1e6), 4)
    one = section(1, bytes([0, 98, 0, 0, 5, 0, 1]) + struct.pack(">H", 2024) + bytes([5, 17, 6, 0, 0, 0, 4]))
    three = section(3, bytes([0]) + (ni * nj).to_bytes(4, "big") + bytes([0, 0, 0, 0, 6]) + b"\xff" * 15 + ni.to_bytes(4, "big") + nj.to_bytes(4, "big") + b"\0" * 4 + b"\xff" * 4 + micro(lat1) + micro(lon1 % 360) + bytes([48]) + micro(lat2) + micro(lon2 % 360) + micro(1) + micro(1) + bytes([mode]))
    product = (11 if member is not None else 8) if interval else (1 if member is not None else 0)
    four = b"\0\0" + struct.pack(">H", product) + bytes([1, 8, 2, 0, 0, 0, 0, 0, 1]) + sign(step - (interval or 0), 4) + bytes([103]) + sign(0, 1) + sign(2, 4) + b"\xff" * 6
    if member is not None:
        four += bytes([3, member, 50])
    if interval:
        four += struct.pack(">H", 2024) + bytes([5, 18, 0, 0, 0, 1]) + b"\0" * 4 + bytes([1, 2, 1]) + interval.to_bytes(4, "big") + bytes([255]) + b"\0" * 4
    body = one + three + section(4, four)
    for k, g in enumerate([grid, *(again or [])]):
        flat = g.ravel()
        there = ~np.isnan(flat)
        scaled = np.round((flat[there] * 10**decimal - np.floor(np.nanmin(flat) * 10**decimal)) / 2.0**binary).astype(np.int64)
        reference = struct.pack(">f", np.floor(np.nanmin(flat) * 10**decimal))
        body += section(5, len(scaled).to_bytes(4, "big") + struct.pack(">H", packing) + reference + sign(binary, 2) + sign(decimal, 2) + bytes([bits, 0]))
        body += section(6, bytes([255]) if there.all() and not k else bytes([254]) if k else bytes([0]) + np.packbits(there).tobytes())
        body += section(7, packed(scaled, bits))
    size = 16 + len(body) + 4
    return b"GRIB\0\0" + bytes([0, 2]) + size.to_bytes(8, "big") + body + b"7777"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = np.random.default_rng(3)
    at = tmp_path_factory.mktemp("grib")
    grids = {(m, s): np.round(rng.uniform(-5, 60, (5, 7)), 1) for m in (1, 2) for s in (24, 48)}
    for m in (1, 2):
        (at / f"m{m}.grib2").write_bytes(b"\0junk" + b"between".join(message(grids[m, s], 55.0, -6.0, s, m, s) for s in (24, 48)) + b"GRIB cut short")
    (at / "notes.grib2").write_bytes(b"")
    return at, grids


def test_fields_come_back(spark, files):
    at, grids = files
    told = grib.messages(spark, str(at)).cache()
    rows = {(r.member, r.step): r for r in told.collect()}
    assert set(rows) == set(grids) and all(r.known and r.interval == s and r.category == 1 and r.parameter == 8 and r.level == 2.0 and (r.ni, r.nj) == (7, 5) for (_, s), r in rows.items())
    assert {r.run for r in told.select(F.date_format("run", "yyyy-MM-dd HH:mm").alias("run")).collect()} == {"2024-05-17 06:00"}
    assert [rows[1, s].message for s in (24, 48)] == [0, 1]
    found = {(r.member, r.step, r.lat, r.lon): r.value for r in grib.cells(told).collect()}
    assert len(found) == 4 * 35
    for (m, s), g in grids.items():
        for j in range(5):
            for i in range(7):
                assert found[m, s, 55.0 - j, -6.0 + i] == pytest.approx(g[j, i], abs=0.0126)


def test_filters_and_boxes_leave_fields_alone(spark, files, monkeypatch):
    at, grids = files
    fields = grib.messages(spark, str(at)).filter("member = 2 and step <= 24")
    got = grib.cells(fields, 52.0, -5.0, 53.5, -3.0)
    assert sorted((r.lat, r.lon) for r in got.collect()) == [(la, lo) for la in (52.0, 53.0) for lo in (-5.0, -4.0, -3.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow decoded") < plan.index("(member") < plan.index("MapInArrow _split")
    assert grib.cells(fields, 0.0, 0.0, 1.0, 1.0).count() == 0


def test_scans_bitmaps_and_what_is_not_known():
    g = np.arange(12.0).reshape(3, 4)
    g[1, 2] = np.nan
    for mode, bits in ((0x40, 16), (0x80, 8), (0, 7), (0x10, 12)):
        (d, s), (_, second) = grib.split(message(g, 10.0, 179.0, 6, bits=bits, decimal=0, binary=0, mode=mode, again=[g + 1]))
        assert grib.header(d, s)["step"] == 6 and grib.header(d, s)["known"] and grib.header(d, s).get("member") is None
        assert np.array_equal(grib.values(s), g.ravel(), equal_nan=True) and np.array_equal(grib.values(second), g.ravel() + 1, equal_nan=True)
        lat, lon = grib.axes(s[3])
        assert lat.tolist() == ([10, 11, 12] if mode & 0x40 else [10, 9, 8])
        assert lon.tolist() == ([179, 178, 177, 176] if mode & 0x80 else [179, -180, -179, -178])
    flat = np.full((2, 2), 3.0)
    assert grib.values(grib.split(message(flat, 1.0, 1.0, 1, bits=0, decimal=0, binary=0))[0][1]).tolist() == [3.0] * 4
    assert not grib.header(*grib.split(message(flat, 1.0, 1.0, 1, packing=40))[0])["known"]
    assert grib.split(b"") == grib.split(b"GRIB") == grib.split(message(flat, 1.0, 1.0, 1)[:-1]) == []


def test_rows_that_turn(spark, tmp_path):
    g = np.arange(6.0).reshape(2, 3)
    (tmp_path / "a.grib2").write_bytes(message(g, 10.0, -1.0, 0, bits=8, decimal=0, binary=0, mode=0x10))
    got = {(r.lat, r.lon): r.value for r in grib.cells(grib.messages(spark, str(tmp_path)), west=0.5, east=-0.5).collect()}
    assert got == {(10.0, -1.0): 0.0, (10.0, 1.0): 2.0, (9.0, -1.0): 5.0, (9.0, 1.0): 3.0}
    day = datetime.datetime(2024, 5, 17, 6)
    assert grib.messages(spark, str(tmp_path)).filter(F.col("run") == F.lit(day)).count() <= 1
