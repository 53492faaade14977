"""Texture atlases: the images of a tile packed into one, by guillotine cuts.

Images are placed by falling area. The sheet starts as the first power of two above the root of the summed areas;
when an image doesn't fit, width and height are doubled in turn and packing starts anew. A tile's images are bounded
by the kd-tree's maximum, so one task packs a tile. Nulls and images without area are left out; ties are in input order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

PLACED = "tile int, id long, left int, top int, width int, height int, sheet_width int, sheet_height int"


#: Free rectangles a block of them has at most; larger ones are halved.
BLOCK = 128


class _Block:
    """Some neighbouring free rectangles (left, top, width, height), with no less than their largest width and height."""

    def __init__(self, free: list[tuple[int, int, int, int]]):
        self.free, self.width, self.height = free, max((r[2] for r in free), default=0), max((r[3] for r in free), default=0)


class _Sheet:
    """The free rectangles that cuts leave, in the order of the tree of cuts, in blocks.

    The first one that is large enough takes the image. Free room only shrinks, so images of one size in a row go on where the
    last was placed; blocks whose bounds are too small are passed over, and rectangles too small for any image aren't kept.
    """

    def __init__(self, width: int, height: int, least_w: int, least_h: int):
        self.least, self.blocks, self.size, self.at = (least_w, least_h), [_Block([(0, 0, width, height)])], None, (0, 0)

    def place(self, w: int, h: int) -> tuple[int, int] | None:
        k, i = self.at if self.size == (w, h) else (0, 0)
        self.size = w, h
        while k < len(self.blocks):
            b = self.blocks[k]
            if w <= b.width and h <= b.height:
                for j in range(i, len(b.free)):
                    if w <= b.free[j][2] and h <= b.free[j][3]:
                        return self._cut(k, j, w, h)
                if not i:  # else its bounds would be tried again and again
                    self.blocks[k] = _Block(b.free)
            k, i = k + 1, 0
        self.at = k, 0
        return None

    def _cut(self, k: int, j: int, w: int, h: int) -> tuple[int, int]:
        b = self.blocks[k]
        left, top, free_w, free_h = b.free[j]
        below, beside = free_h - h - 1, free_w - w - 1
        # a pixel is left between neighbours
        if free_w - w >= free_h - h:
            rest = [(left, top + h + 1, w, below), (left + w + 1, top, beside, free_h)]
        else:
            rest = [(left + w + 1, top, beside, h), (left, top + h + 1, free_w, below)]
        b.free[j : j + 1] = [r for r in rest if r[2] >= self.least[0] and r[3] >= self.least[1]]
        self.at = k, j
        if len(b.free) > BLOCK:
            half = len(b.free) // 2
            self.blocks[k : k + 1] = [_Block(b.free[:half]), _Block(b.free[half:])]
            self.at = (k, j) if j < half else (k + 1, j - half)
        elif not b.free:
            del self.blocks[k]
            self.at = k, 0
        return left, top


def pack(sizes: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """(left, top) of each image and the sheet's width and height."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i][0] * sizes[i][1])
    side = 1
    while side * side < sum(w * h for w, h in sizes):
        side *= 2
    width = height = side
    least = min((w for w, _ in sizes), default=1), min((h for _, h in sizes), default=1)
    wider = True
    while True:
        sheet, out = _Sheet(width, height, *least), {}
        for i in order:
            at = sheet.place(*sizes[i])
            if at is None:
                break
            out[i] = at
        if len(out) == len(sizes):
            return [out[i] for i in range(len(sizes))], width, height
        width, height = (width * 2, height) if wider else (width, height * 2)
        wider = not wider


def packed(images: DataFrame) -> DataFrame:
    """images(tile, ord, id, width, height) to the place of each on its tile's sheet."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.dropna(subset=["width", "height"])
        t = t[(t["width"] > 0) & (t["height"] > 0)].sort_values("ord")
        at, w, h = pack([*zip(t["width"].astype(int), t["height"].astype(int), strict=True)]) if len(t) else ([], 0, 0)
        return pd.DataFrame({"tile": t["tile"], "id": t["id"], "left": [p[0] for p in at], "top": [p[1] for p in at], "width": t["width"], "height": t["height"], "sheet_width": w, "sheet_height": h})

    return images.select("tile", "ord", "id", "width", "height").groupBy("tile").applyInPandas(run, PLACED)
