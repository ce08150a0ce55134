"""Equal-area projection (ellipsoidal Lambert azimuthal, after Snyder, USGS PP 1395) and planar distances as column
expressions, so projecting stays inside code generation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
KM_PER_DEGREE = 111.0


@dataclass(frozen=True)
class Laea:
    """Projection centred on (lat0, lon0), in degrees; metres east and north of the centre."""

    lat0: float
    lon0: float

    @classmethod
    def for_box(cls, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> Laea:
        """Centred on the box, to four decimals."""
        return cls(round((lat_min + lat_max) / 2, 4), round((lon_min + lon_max) / 2, 4))

    @property
    def crs(self) -> str:
        return f"+proj=laea +lat_0={self.lat0:.4f} +lon_0={self.lon0:.4f} +datum=WGS84 +units=m"

    @property
    def _e2(self) -> float:
        return WGS84_F * (2 - WGS84_F)

    def _q(self, s: float) -> float:
        e = math.sqrt(self._e2)
        return (1 - self._e2) * (s / (1 - self._e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    @property
    def _constants(self) -> tuple[float, float, float, float]:
        """(q at the pole, authalic radius, authalic latitude of the centre, scale factor D)."""
        qp, phi = self._q(1.0), math.radians(self.lat0)
        radius = WGS84_A * math.sqrt(qp / 2)
        beta = math.asin(self._q(math.sin(phi)) / qp)
        m = math.cos(phi) / math.sqrt(1 - self._e2 * math.sin(phi) ** 2)
        return qp, radius, beta, WGS84_A * m / (radius * math.cos(beta))

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """(x, y) in metres."""
        qp, radius, b1, d = self._constants
        e, e2 = math.sqrt(self._e2), self._e2
        s = F.sin(F.radians(lat))
        q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        beta, dl = F.asin(q / qp), F.radians(lon) - math.radians(self.lon0)
        scale = radius * F.sqrt(2 / (1 + math.sin(b1) * F.sin(beta) + math.cos(b1) * F.cos(beta) * F.cos(dl)))
        return scale * d * F.cos(beta) * F.sin(dl), scale / d * (math.cos(b1) * F.sin(beta) - math.sin(b1) * F.cos(beta) * F.cos(dl))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lat, lon) in degrees."""
        qp, radius, b1, d = self._constants
        e2 = self._e2
        rho = F.sqrt(F.pow(x / d, 2) + F.pow(y * d, 2))
        ce = 2 * F.asin(rho / (2 * radius))
        at_centre = rho == 0
        safe = F.when(at_centre, F.lit(1.0)).otherwise(rho)
        q = F.when(at_centre, F.lit(math.sin(b1))).otherwise(F.cos(ce) * math.sin(b1) + d * y * F.sin(ce) * math.cos(b1) / safe)
        beta = F.asin(q)
        c2 = e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040
        c4 = 23 * e2**2 / 360 + 251 * e2**3 / 3780
        c6 = 761 * e2**3 / 45360
        lat = beta + c2 * F.sin(2 * beta) + c4 * F.sin(4 * beta) + c6 * F.sin(6 * beta)
        lon = math.radians(self.lon0) + F.atan2(x * F.sin(ce), d * safe * math.cos(b1) * F.cos(ce) - d * d * y * math.sin(b1) * F.sin(ce))
        return F.degrees(lat), F.degrees(F.when(at_centre, F.lit(math.radians(self.lon0))).otherwise(lon))

    def forward_point(self, lat: float, lon: float) -> tuple[float, float]:
        """As :meth:`forward`, for a number on the driver."""
        qp, radius, b1, d = self._constants
        beta, dl = math.asin(self._q(math.sin(math.radians(lat))) / qp), math.radians(lon - self.lon0)
        scale = radius * math.sqrt(2 / (1 + math.sin(b1) * math.sin(beta) + math.cos(b1) * math.cos(beta) * math.cos(dl)))
        return scale * d * math.cos(beta) * math.sin(dl), scale / d * (math.cos(b1) * math.sin(beta) - math.sin(b1) * math.cos(beta) * math.cos(dl))


def euclidean(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def equirectangular_km(lat: Column, lon: Column, mean_lat: float) -> tuple[Column, Column]:
    """(x, y) in km with a degree of 111 km, longitudes shortened by the cosine of the mean latitude."""
    return lon * (math.cos(math.radians(mean_lat)) * KM_PER_DEGREE), lat * KM_PER_DEGREE
