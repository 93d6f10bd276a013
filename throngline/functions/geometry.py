"""Planar geometry: homographies on the driver, everything per row as Column builders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from ..config import Region, Scene

UNCALIBRATED_M_PER_PX = 0.05


def homography(image: list, world: list) -> np.ndarray:
    """The 3x3 map of image points to world points (four pairs or more), scaled to H[2, 2] = 1; degenerate points are refused."""
    if len(image) != len(world) or len(image) < 4:
        raise ValueError("four point pairs or more are needed")
    rows = []
    for (x, y), (u, v) in zip(image, world, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    _, size, turns = np.linalg.svd(np.array(rows, dtype=float))
    h = turns[-1].reshape(3, 3)
    if abs(h[2, 2]) < 1e-12 or size[7] < 1e-12 * size[0]:
        raise ValueError("degenerate points")
    return h / h[2, 2]


def ground(scene: Scene) -> np.ndarray:
    """The scene's homography; uncalibrated scenes use a fixed scale."""
    if len(scene.image_points) == len(scene.world_points) == 4:
        return homography(list(scene.image_points), list(scene.world_points))
    return np.diag([UNCALIBRATED_M_PER_PX, UNCALIBRATED_M_PER_PX, 1.0])


def project(h: np.ndarray, x: Column, y: Column) -> tuple[Column, Column]:
    """Ground coordinates of an image point."""
    line = lambda r: F.lit(float(h[r, 0])) * x + F.lit(float(h[r, 1])) * y + F.lit(float(h[r, 2]))
    w = F.when(F.abs(line(2)) < 1e-12, F.lit(1e-12)).otherwise(line(2))
    return line(0) / w, line(1) / w


def pixel_area(h: np.ndarray, x: Column, y: Column) -> Column:
    """Ground area of the pixel whose corner is (x, y), by the Jacobian at its centre."""
    w = F.abs(F.lit(float(h[2, 0])) * (x + 0.5) + F.lit(float(h[2, 1])) * (y + 0.5) + F.lit(float(h[2, 2])))
    return F.lit(abs(float(np.linalg.det(h)))) / F.pow(F.when(w < 1e-9, F.lit(1e-9)).otherwise(w), 3)


def shoelace(polygon: Column) -> Column:
    """Area of an array of (x, y); under three points 0."""
    nxt = lambda i: F.get(polygon, (i + 1) % F.size(polygon))
    terms = F.transform(polygon, lambda p, i: p["x"] * nxt(i)["y"] - nxt(i)["x"] * p["y"])
    return F.when(F.size(polygon) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)) / 2)


def projected(h: np.ndarray, polygon: Column) -> Column:
    return F.transform(polygon, lambda p: F.struct(project(h, p["x"], p["y"])[0].alias("x"), project(h, p["x"], p["y"])[1].alias("y")))


def inside(region: Region, x: Column, y: Column) -> Column:
    """Even-odd rule as an expression over literals, behind a bounding-box test. Horizontal edges don't count."""
    xs, ys = [p[0] for p in region.polygon], [p[1] for p in region.polygon]
    crossings = F.lit(0)
    for (xi, yi), (xj, yj) in zip(region.polygon, region.polygon[1:] + region.polygon[:1], strict=True):
        if yi != yj:
            at = F.lit(float(xj - xi)) * (y - float(yi)) / float(yj - yi) + float(xi)
            crossings = crossings + F.when(((F.lit(float(yi)) > y) != (F.lit(float(yj)) > y)) & (x < at), 1).otherwise(0)
    return (x >= min(xs)) & (x <= max(xs)) & (y >= min(ys)) & (y <= max(ys)) & (crossings % 2 == 1)


def bearing(vx: Column, vy: Column) -> Column:
    """Degrees clockwise from up (0) over right (90)."""
    return F.pmod(F.degrees(F.atan2(vx, -vy)), F.lit(360.0))


def region_area(scene: Scene, region: Region) -> float:
    """Ground area of a region in square metres, on the driver."""
    h = ground(scene)
    p = [h @ [x, y, 1.0] for x, y in region.polygon]
    q = [(v[0] / v[2], v[1] / v[2]) for v in p]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q, q[1:] + q[:1], strict=True))) / 2
