"""Squarified treemap of each official's donors (L1 to L3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civictally.session import ship


def squarify(areas: list[float], width: float, height: float) -> list[tuple[float, float, float, float]]:
    """Rectangles x, y, w, h for areas in falling order that sum to ``width * height``.

    Bruls, Huizing and van Wijk (2000): strips along the shorter side of the free
    rectangle, each taking areas while its worst aspect ratio does not rise.
    """
    x = y = 0.0
    out = []
    at = 0
    while at < len(areas) and width > 0 and height > 0:
        side = min(width, height)
        total, end = areas[at], at + 1
        worst = max(side * side / total, total / (side * side))
        while end < len(areas):
            grown = total + areas[end]
            # the first area of a strip is its largest, the last one its smallest
            ratio = max(side * side * areas[at] / grown**2, grown**2 / (side * side * areas[end]))
            if ratio > worst:
                break
            total, worst, end = grown, ratio, end + 1
        strip = areas[at:end]
        depth = total / side
        w, h = (width, depth) if width < height else (depth, height)
        if len(strip) == 1 and end == len(areas):
            w, h = width, height
        along = 0.0
        for a in strip:
            # a strip is cut across its longer side
            if w < h:
                out.append((x, y + along, w, a / w))
                along += a / w
            else:
                out.append((x + along, y, a / h, h))
                along += a / h
        if width < height:
            y, height = y + depth, height - depth
        else:
            x, width = x + depth, width - depth
        at = end
    return out


# Share of the width that is the height, its bounds, the gap between tiles and their least side,
# and what a tile must exceed to carry a label.
RATIO, LOWEST, HIGHEST, NARROWEST = 0.55, 320.0, 560.0, 640.0
GAP, LEAST, LABEL = 2.0, 1.0, (46.0, 26.0)


def box(width: float | None) -> tuple[float, float]:
    """L3: width and height of the drawing for a container's width, which may not be known."""
    wide = width or NARROWEST
    return wide, max(LOWEST, min(HIGHEST, wide * RATIO))


def treemap(donors: DataFrame, width: float | None = 800.0, height: float | None = None) -> DataFrame:
    """L2, L3: tiles of the ranked donors with a positive total: ``official_id``, ``donor_rank``,
    x, y, w, h, the drawn sides ``shown_w`` and ``shown_h`` (less the gap, a pixel at least) and whether
    the tile is large enough for a label. Without a height it follows from the width. Ranked
    donors are a bounded number an official."""
    wide, high = box(width)
    width, height = wide, height or high

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, donors in zip(pdf["official_id"], pdf["donors"]):
                sizes = sorted(((d["size"], d["donor_rank"]) for d in donors), key=lambda d: (-d[0], d[1]))
                scale = width * height / sum(s for s, _ in sizes)
                tiles = squarify([s * scale for s, _ in sizes], width, height)
                shown = lambda t: (max(t[2] - GAP, LEAST), max(t[3] - GAP, LEAST), t[2] > LABEL[0] and t[3] > LABEL[1])
                out += [(key, rank, *t, *shown(t)) for (_, rank), t in zip(sizes, tiles)]
            yield pd.DataFrame(out, columns=["official_id", "donor_rank", "x", "y", "w", "h", "shown_w", "shown_h", "labelled"])

    ship(donors.sparkSession)
    rows = donors.where("total > 0").selectExpr("official_id", "donor_rank", "greatest(cast(total as double), 0.01D) as size")
    lists = rows.groupBy("official_id").agg(F.collect_list(F.struct("size", "donor_rank")).alias("donors"))
    return lists.mapInPandas(run, "official_id string, donor_rank int, x double, y double, w double, h double, shown_w double, shown_h double, labelled boolean")
