"""Ensemble providers behind one interface, as a Spark data source: ``spark.read.format("ensemble").option("provider", name)``."""

from __future__ import annotations

import datetime as dt
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "lat double, lon double, member int, date date, value double"
PROVIDERS: dict[str, type] = {}


def provider(name: str):
    """Register a provider: a class with ``members`` and ``fetch(lat, lon, member, start, horizon) -> values``."""

    def add(cls):
        PROVIDERS[name] = cls
        return cls

    return add


@provider("synthetic")
class Synthetic:
    """Gamma-distributed amounts, seeded by place and member: for rehearsals without a network."""

    members = 8

    def fetch(self, lat: float, lon: float, member: int, start: dt.date, horizon: int) -> list[float]:
        draw = np.random.default_rng(zlib.crc32(f"{lat:.4f},{lon:.4f},{member},{start}".encode()))
        return draw.gamma(0.6, 4.0, horizon).round(3).tolist()


class _Part(InputPartition):
    def __init__(self, lat: float, lon: float, member: int):
        self.lat, self.lon, self.member = lat, lon, member


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.source = PROVIDERS[options.get("provider", "synthetic")]()
        self.start, self.horizon = dt.date.fromisoformat(options["start"]), int(options.get("horizon", "14"))
        self.places = [tuple(map(float, p.split(","))) for p in options["places"].split(";")]

    def partitions(self) -> list[InputPartition]:
        return [_Part(lat, lon, m) for lat, lon in self.places for m in range(self.source.members)]

    def read(self, part: _Part) -> Iterator[tuple]:
        for i, v in enumerate(self.source.fetch(part.lat, part.lon, part.member, self.start, self.horizon)):
            yield part.lat, part.lon, part.member, self.start + dt.timedelta(i), v


class EnsembleSource(DataSource):
    """Options: provider, start (ISO date), horizon (days), places ("lat,lon;lat,lon"). One partition a place and member."""

    @classmethod
    def name(cls) -> str:
        return "ensemble"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
