"""Zonal crop area after a morphological opening, on a long table of cells, tile by tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rillwork import config
from rillwork.functions import columns as X


def _near(mask: np.ndarray, radius: int) -> np.ndarray:
    """Which cells have a set cell within ``radius``, by exact distances.

    A first pass gives every cell its distance along the column to the nearest set cell; a cell is near if in a column
    ``dy`` away that distance is at most sqrt(radius^2 - dy^2): 2 * radius + 1 comparisons instead of one for each place of the disc.
    """
    h, w = mask.shape
    away = np.where(mask, 0, radius + 1).astype(np.int32)
    for i in range(1, h):
        np.minimum(away[i], away[i - 1] + 1, out=away[i])
    for i in range(h - 2, -1, -1):
        np.minimum(away[i], away[i + 1] + 1, out=away[i])
    out = np.zeros_like(mask)
    for dy in range(-radius, radius + 1):
        reach = int(np.floor(np.sqrt(radius * radius - dy * dy)))
        a, b = max(0, -dy), min(w, w - dy)
        out[:, a:b] |= away[:, a + dy:b + dy] <= reach
    return out


def _opening(mask: np.ndarray, radius: int) -> np.ndarray:
    """Erode, then dilate with a disc; everything outside the block counts as empty."""
    inner = (slice(radius, radius + mask.shape[0]), slice(radius, radius + mask.shape[1]))
    return _near(mask & ~_near(~np.pad(mask, radius), radius)[inner], radius)


def opened_cells(cells: DataFrame, radius: int = 13, tile: int = 256, lo: int = 1, hi: int = 80) -> DataFrame:
    """Crop cells (class lo..hi) with a flag: kept by the opening. Input: x, y, class, zone, one row per cell.

    A cell also travels to the tiles whose core lies within two radii, so that every tile can decide its own core
    alone. A tile holds at most (tile + 4 * radius)^2 cells whatever the size of the raster.
    """
    halo = 2 * radius
    crop = cells.where(F.col("class").between(lo, hi)).select("x", "y", "zone")
    tiles = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    spread = crop.withColumn("tx", F.explode(tiles("x"))).withColumn("ty", F.explode(tiles("y")))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["tx"].iat[0]) * tile - halo, int(pdf["ty"].iat[0]) * tile - halo
        xs, ys = pdf["x"].to_numpy() - x0, pdf["y"].to_numpy() - y0
        mask = np.zeros((tile + 2 * halo, tile + 2 * halo), dtype=bool)
        mask[xs, ys] = True
        core = (xs >= halo) & (xs < halo + tile) & (ys >= halo) & (ys < halo + tile)
        out = pdf.loc[core, ["x", "y", "zone"]].copy()
        out["kept"] = _opening(mask, radius)[xs[core], ys[core]]
        return out

    zone_type = cells.schema["zone"].dataType.simpleString()
    return spread.groupBy("tx", "ty").applyInPandas(keep, f"x long, y long, zone {zone_type}, kept boolean")


def zonal_share(opened: DataFrame, cell_m2: float = 900.0, min_acres: float = 40.0) -> DataFrame:
    """Crop acres, kept acres and their ratio (at most 1) per zone with enough crop land."""
    acre = cell_m2 / config.SQ_M_PER_ACRE
    kept: Column = F.sum(F.when(F.col("kept"), 1).otherwise(0)) * acre
    agg = opened.groupBy("zone").agg(kept.alias("centerpivot_ac"), (F.count(F.lit(1)) * acre).alias("total_crop_ac"))
    share = F.least(X.ratio("centerpivot_ac", "total_crop_ac"), F.lit(1.0))
    return agg.where(F.col("total_crop_ac") > min_acres).withColumn("centerpivot_ratio", F.round(share, 3))
