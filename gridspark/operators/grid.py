"""Regular grids: where the axes lie, which cell a point falls in, tables of cells and nodes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.geo import Laea


@dataclass(frozen=True)
class Grid:
    """Cell centres x0 + ix * res, y0 + iy * res, counted from the south-west."""

    x0: float
    y0: float
    res: float
    nx: int
    ny: int
    crs: str = ""

    @classmethod
    def for_box(cls, lat_min: float, lat_max: float, lon_min: float, lon_max: float, res: float, proj: Laea | None = None) -> Grid:
        """Grid over the projected corners of a box, its ends snapped outwards to multiples of ``res``."""
        proj = proj or Laea.for_box(lat_min, lat_max, lon_min, lon_max)
        corners = [proj.forward_point(a, o) for a in (lat_min, lat_max) for o in (lon_min, lon_max)]
        lows = [math.floor(min(c[i] for c in corners) / res) for i in (0, 1)]
        highs = [math.ceil(max(c[i] for c in corners) / res) for i in (0, 1)]
        return cls(lows[0] * res, lows[1] * res, res, highs[0] - lows[0] + 1, highs[1] - lows[1] + 1, proj.crs)

    def coarse(self, res: float) -> Grid:
        """Nodes every ``res`` from the first centre, up to half a step beyond the last (never including that end)."""
        count = lambda n: max(1, math.ceil(((n - 1) * self.res + res / 2) / res))
        return Grid(self.x0, self.y0, res, count(self.nx), count(self.ny), self.crs)

    def key(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(iy, ix) of the cell that holds a point, NULL outside the grid."""
        def one(v: Column, start: float, n: int) -> Column:
            i = F.floor((v - (start - self.res / 2)) / self.res).cast("int")
            return F.when(i.between(0, n - 1), i)

        iy, ix = one(y, self.y0, self.ny), one(x, self.x0, self.nx)
        return F.when(ix.isNotNull(), iy), F.when(iy.isNotNull(), ix)

    def x_of(self, ix: Column) -> Column:
        return ix * F.lit(float(self.res)) + F.lit(float(self.x0))

    def y_of(self, iy: Column) -> Column:
        return iy * F.lit(float(self.res)) + F.lit(float(self.y0))

    def cells(self, spark: SparkSession) -> DataFrame:
        """``iy, ix, y, x`` of every cell, made on the executors."""
        d = spark.range(self.nx * self.ny).select((F.col("id") / self.nx).cast("int").alias("iy"), (F.col("id") % self.nx).cast("int").alias("ix"))
        return d.withColumns({"y": self.y_of(F.col("iy")), "x": self.x_of(F.col("ix"))})

    def cells_geographic(self, spark: SparkSession, proj: Laea) -> DataFrame:
        """Cells with the latitude and longitude of their centres."""
        c = self.cells(spark)
        lat, lon = proj.inverse(F.col("x"), F.col("y"))
        return c.withColumns({"lat": lat, "lon": lon})


def mesh(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """Two-dimensional coordinates of a raster from its one-dimensional axes (``iy, lat`` and ``ix, lon``).

    The result is the raster's own size; the axes are its rows' and columns' labels.
    """
    return lats.crossJoin(lons)
