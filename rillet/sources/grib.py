"""Gridded forecasts in GRIB edition 2, read by Spark: messages of files in any store, headers first, values of those that are asked for.

``messages`` splits files and reads each message's sections but not its values: filters on member, step, level or parameter, and a choice of columns, act on a
hundred bytes a message. ``cells`` decodes the values of what is left, within a box. Regular latitude-longitude grids (template 3.0), products at one time or
over an interval, single or of an ensemble (4.0, 4.1, 4.8, 4.11), and simple packing (5.0), with or without a bitmap, are known; other messages are told with
``known`` false and have no cells."""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Fixed values of the format: hours in a unit of time (its code: 1 hour, 0 minute, 2 day, 10 to 12 three, six and twelve hours, 13 second).
UNIT_HOURS = {0: 1 / 60, 1: 1.0, 2: 24.0, 10: 3.0, 11: 6.0, 12: 12.0, 13: 1 / 3600}
HEADER = "path string, message int, run timestamp, discipline int, category int, parameter int, surface int, level double, step double, interval double, member int, ni int, nj int, known boolean, body binary"


def _signed(b: bytes) -> int:
    """A whole number with its sign in the first bit."""
    n = int.from_bytes(b, "big")
    top = 1 << (8 * len(b) - 1)
    return -(n - top) if n >= top else n


def _u(b: bytes, at: int, n: int) -> int:
    """Octets from ``at`` on, counted from 1 as the format does."""
    return int.from_bytes(b[at - 1 : at - 1 + n], "big")


def split(data: bytes) -> list[tuple[int, dict[int, bytes]]]:
    """(discipline, sections by number) of each field of a file. Sections repeat within a message for further fields; what is between messages, or a message
    that is cut short, is passed over."""
    out, at = [], 0
    while (at := data.find(b"GRIB", at)) >= 0:
        size = _u(data[at : at + 16], 9, 8) if len(data) >= at + 16 else 0
        end = at + size
        if size < 20 or end > len(data) or data[at + 7] != 2 or data[end - 4 : end] != b"7777":
            at += 4
            continue
        discipline, sections, here = data[at + 6], {}, at + 16
        while here + 5 <= end - 4:
            n, number = _u(data[here : here + 5], 1, 4), data[here + 4]
            if n < 5:
                break
            if number != 6 or data[here + 5] != 254 or 6 not in sections:  # 254: the bitmap before holds on
                sections[number] = data[here : here + n]
            if number == 7:
                out.append((discipline, dict(sections)))
            here += n
        at = end
    return out


def header(discipline: int, s: dict[int, bytes]) -> dict:
    """The columns of HEADER but for path, message and body."""
    one, three, four, five = (s.get(i, b"") for i in (1, 3, 4, 5))
    told = {"discipline": discipline, "known": False}
    if not all((one, three, four, five)):
        return told
    told["run"] = datetime.datetime(_u(one, 13, 2), *one[14:19], tzinfo=datetime.timezone.utc)
    product = _u(four, 8, 2)
    told["known"] = _u(three, 13, 2) == 0 and product in (0, 1, 8, 11) and _u(five, 10, 2) == 0 and _u(three, 7, 4) == _u(three, 31, 4) * _u(three, 35, 4)
    if product not in (0, 1, 8, 11):
        return told
    hours = UNIT_HOURS.get(four[17])
    told |= {"category": four[9], "parameter": four[10], "surface": four[22], "level": _signed(four[24:28]) / 10.0 ** _signed(four[23:24]) if four[23] != 255 else None, "ni": _u(three, 31, 4), "nj": _u(three, 35, 4)}
    told["step"] = _signed(four[18:22]) * hours if hours else None
    told["member"] = four[35] if product in (1, 11) else None
    if product in (8, 11):  # the interval begins at the step; its unit and length stand behind what is left out here
        at = 35 + (3 if product == 11 else 0) + 7 + 1 + 4 + 2
        length = UNIT_HOURS.get(four[at - 1])
        told["interval"] = _u(four, at + 1, 4) * length if length else None
        told["step"] = told["step"] + told["interval"] if told["step"] is not None and told["interval"] is not None else None
    return told


def unpack(packed: bytes, bits: int, n: int) -> np.ndarray:
    """``n`` whole numbers of ``bits`` bits each, one after the other."""
    if bits == 0:
        return np.zeros(n, np.int64)
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f">u{bits // 8}", n).astype(np.int64)
    each = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * bits).reshape(n, bits)
    return each.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def values(s: dict[int, bytes]) -> np.ndarray:
    """A field's values in the order of its grid, nan where its bitmap has none."""
    five, six, seven = s[5], s.get(6, b"\0\0\0\0\6\xff"), s[7]
    reference, n = np.frombuffer(five[11:15], ">f4")[0].astype(float), _u(five, 6, 4)
    packed = unpack(seven[5:], five[19], n)
    told = (reference + packed * 2.0 ** _signed(five[15:17])) / 10.0 ** _signed(five[17:19])
    if six[5] == 255:
        return told
    there = np.unpackbits(np.frombuffer(six[6:], np.uint8), count=_u(s[3], 7, 4)).astype(bool)
    out = np.full(len(there), np.nan)
    out[there] = told
    return out


def axes(three: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(latitudes of rows, longitudes of columns from -180 to 180) of a regular grid."""
    ni, nj, mode = _u(three, 31, 4), _u(three, 35, 4), three[71]
    lat1, lon1, lat2, lon2 = (_signed(three[i - 1 : i + 3]) / 1e6 for i in (47, 51, 56, 60))
    east = not mode & 0x80
    width = ((lon2 - lon1) if east else (lon1 - lon2)) % 360 if ni > 1 else 0.0
    lon = lon1 + (1 if east else -1) * np.linspace(0, width, ni)
    return np.linspace(lat1, lat2, nj), (lon + 180) % 360 - 180


def _header_type() -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (c.split() for c in HEADER.split(", "))])


def _split(batches):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_header_type())
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content")):
            for i, (discipline, s) in enumerate(split(content.as_buffer().to_pybytes())):
                body = b"".join(s[k] for k in (3, 5, 6, 7) if k in s)
                yield pa.RecordBatch.from_pylist([{"path": path, "message": i, "body": body, **header(discipline, s)}], schema)


def messages(spark: SparkSession, path: str) -> DataFrame:
    """HEADER of each field of the files at ``path``, a glob or folder. ``message`` counts within a file; ``step`` is the end of the interval, in hours. Files are
    split where they lie, one a task at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_split, _header_type())


def cells(fields: DataFrame, south: float = -90.0, west: float = -180.0, north: float = 90.0, east: float = 180.0) -> DataFrame:
    """The known of ``fields`` (columns of ``messages`` with body) as (path, message, run, step, interval, member, parameter, lat, lon, value), one row a cell within
    the box; west may lie east of east, around the turn of longitude. Cells without a value have null."""
    keys = ["path", "message", "run", "step", "interval", "member", "parameter"]
    schema = T.StructType([*(f for f in fields.schema if f.name in keys), *(T.StructField(n, T.DoubleType()) for n in ("lat", "lon", "value"))])
    names = [f.name for f in schema if f.name in keys]

    def decoded(batches):
        for b in batches:
            for i, body in enumerate(b.column("body").to_pylist()):
                s, at = {}, 0
                while at < len(body):
                    n = _u(body[at : at + 4], 1, 4)
                    s[body[at + 4]] = body[at : at + n]
                    at += n
                lat, lon = axes(s[3])
                rows = np.flatnonzero((lat >= south - 1e-9) & (lat <= north + 1e-9))
                columns = np.flatnonzero((lon >= west - 1e-9) & (lon <= east + 1e-9) if west <= east else (lon >= west - 1e-9) | (lon <= east + 1e-9))
                if not (len(rows) and len(columns)):
                    continue
                told, mode = values(s), s[3][71]
                grid = told.reshape(len(lon), len(lat)).T if mode & 0x20 else told.reshape(len(lat), len(lon))
                if mode & 0x10:
                    grid = grid.copy()
                    grid[1::2] = grid[1::2, ::-1]
                found, k = grid[np.ix_(rows, columns)].ravel(), len(rows) * len(columns)
                head = [b.column(n).slice(i, 1).take(pa.array(np.zeros(k, np.int64))) for n in names]
                yield pa.RecordBatch.from_arrays([*head, pa.array(np.repeat(lat[rows], len(columns))), pa.array(np.tile(lon[columns], len(rows))), pa.array(found, mask=np.isnan(found))], [*names, "lat", "lon", "value"])

    return fields.filter("known").select(*names, "body").mapInArrow(decoded, schema)
