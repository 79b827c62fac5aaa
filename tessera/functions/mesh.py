"""Organized point clouds and triangle meshes.

A cloud is an array of points. A grid is a struct of width, height and such an array, row by row, with nulls where no
point was seen. A mesh is a struct of vertices, normals (null if unknown) and triangles of three vertex places.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .image import _mapped
from .misc import _coordinate, point3d, point_cloud_bbox_max, point_cloud_bbox_min

POINT = "struct<x:double,y:double,z:double>"
CLOUD = f"array<{POINT}>"
MESH = f"struct<vertices:{CLOUD},normals:{CLOUD},triangles:array<array<int>>>"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _let(x: Column, f) -> Column:
    """A function of a column that is worked out once, however often the function uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _points(a) -> list[dict]:
    return [{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in a]


def _array(points) -> np.ndarray:
    return np.array([(p["x"], p["y"], p["z"]) for p in points], float).reshape(-1, 3)


# Clouds


def pc_empty() -> Column:
    return F.array().cast(CLOUD)


def grid(points: Column, width: int, height: int) -> Column:
    return F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"), points.alias("points"))


def point_cloud_width(g: Column) -> Column:
    return g["width"]


def point_cloud_height(g: Column) -> Column:
    return g["height"]


def point_cloud_is_organized(g: Column) -> Column:
    return (g["width"] > 0) & (g["width"] * g["height"] == F.size(g["points"]))


def point_cloud_has_color(g: Column) -> Column:
    """Clouds here have places only."""
    return F.lit(False)


def point_cloud_depth(g: Column) -> Column:
    """Depths from 0 to 1 within the cloud, row by row; 0 where there is no point."""
    z = F.transform(g["points"], _coordinate("z"))
    low, high = F.array_min(z), F.array_max(z)
    return F.transform(F.arrays_zip(z.alias("z"), F.array_repeat(low, F.size(z)).alias("a"), F.array_repeat(high, F.size(z)).alias("b")), lambda v: F.coalesce((v["z"] - v["a"]) / F.nullif(v["b"] - v["a"], F.lit(0.0)), F.lit(0.0)))


def _intrinsics(width: int, height: int, fov_deg: float) -> tuple[float, float, float, float]:
    f = width / (2 * np.tan(np.radians(fov_deg) / 2))
    return float(f), float(f), (width - 1) / 2, (height - 1) / 2


def _unprojected(depth, width: int, height: int, k: tuple, perspective: bool, confidence=None, least: float = 0.0) -> Column:
    fx, fy, cx, cy = k
    d = _c(depth)

    def point(z: Column, i: Column) -> Column:
        u, v = i % width, F.floor(i / width)
        away = z if perspective else F.lit(1.0)
        p = point3d((u - cx) / fx * away, (v - cy) / fy * away, z)
        return F.when(F.get(_c(confidence), i) >= least, p) if confidence is not None else p

    points = F.transform(d.cast("array<double>"), point)
    return F.filter(points, lambda p: p.isNotNull()) if confidence is not None else grid(points, width, height)


def point_cloud_from_depth_pinhole(depth, width: int, height: int, fov_deg: float) -> Column:
    """A grid of points whose place across grows with depth."""
    return _unprojected(depth, width, height, _intrinsics(width, height, fov_deg), True)


def point_cloud_from_depth_orthographic(depth, width: int, height: int, fov_deg: float) -> Column:
    return _unprojected(depth, width, height, _intrinsics(width, height, fov_deg), False)


def _of(k: list[float]) -> tuple:
    return k[0], k[4], k[2], k[5]


def point_cloud_from_depth_pinhole_intrinsics(depth, width: int, height: int, intrinsics: list[float]) -> Column:
    return _unprojected(depth, width, height, _of(intrinsics), True)


def point_cloud_from_depth_orthographic_intrinsics(depth, width: int, height: int, intrinsics: list[float]) -> Column:
    return _unprojected(depth, width, height, _of(intrinsics), False)


def point_cloud_from_depth_pinhole_with_confidence(depth, confidence, width: int, height: int, fov_deg: float, least: float) -> Column:
    """A cloud of the pixels that are sure enough."""
    return _unprojected(depth, width, height, _intrinsics(width, height, fov_deg), True, confidence, least)


def point_cloud_from_depth_orthographic_with_confidence(depth, confidence, width: int, height: int, fov_deg: float, least: float) -> Column:
    return _unprojected(depth, width, height, _intrinsics(width, height, fov_deg), False, confidence, least)


def point_cloud_from_depth_pinhole_intrinsics_with_confidence(depth, confidence, width: int, height: int, intrinsics: list[float], least: float) -> Column:
    return _unprojected(depth, width, height, _of(intrinsics), True, confidence, least)


def point_cloud_from_points(points, width: int, height: int) -> Column:
    """A grid of three numbers a pixel."""
    flat = _c(points)
    made = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: point3d(*[F.get(flat, i * 3 + k) for k in range(3)]))
    return grid(made, width, height)


def pc_filter_depth_percentile(cloud: Column, lower: float, upper: float) -> Column:
    """Points whose depth lies between two quantiles of the cloud's own, with straight lines between ranks."""

    def bounds(z: Column) -> Column:
        def quantile(q: float) -> Column:
            at = (F.size(z) - 1) * F.lit(q)
            low, high = F.get(z, F.floor(at).cast("int")), F.get(z, F.ceil(at).cast("int"))
            return low + (high - low) * (at - F.floor(at))

        return F.struct(quantile(lower).alias("low"), quantile(upper).alias("high"))

    # sorted once, not for each point
    span = _let(F.array_sort(F.transform(cloud, _coordinate("z"))), bounds)
    return _let(F.struct(cloud.alias("cloud"), span.alias("span")), lambda v: F.filter(v["cloud"], lambda p: p["z"].between(v["span"]["low"], v["span"]["high"])))


def pc_voxel_consensus(cloud, cell: float, votes: int) -> Column:
    """The centre of the points of each cell that has enough of them."""

    def run(points):
        a = _array(points)
        if not len(a):
            return []
        _, own, n = np.unique(np.floor(a / cell), axis=0, return_inverse=True, return_counts=True)
        centres = np.stack([np.bincount(own.ravel(), a[:, k]) for k in range(3)], axis=1) / n[:, None]
        return _points(centres[n >= votes])

    return _mapped(CLOUD, run, cloud)


def point_cloud_to_ply(cloud) -> Column:
    def run(points):
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
        return head.encode() + _array(points).astype("<f4").tobytes()

    return _mapped("binary", run, cloud)


def pointcloud_from_ply(raw) -> Column:
    """Binary little-endian files; properties other than the places are passed over."""
    kinds = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int": "<i4", "uint": "<u4", "short": "<i2", "ushort": "<u2"}

    def run(data):
        data = bytes(data)
        at = data.index(b"end_header\n") + 11
        n, fields, inside = 0, [], False
        for line in data[:at].decode("ascii").splitlines():
            w = line.split()
            if w[:1] == ["element"]:
                inside = w[1] == "vertex"
                n = int(w[2]) if inside else n
            elif w[:1] == ["property"] and inside:
                fields.append((w[2], kinds[w[1]]))
        v = np.frombuffer(data, np.dtype(fields), n, at)
        return _points(np.stack([v["x"], v["y"], v["z"]], axis=1)) if n else []

    return _mapped(CLOUD, run, raw)


# Meshes


def mesh(vertices: Column, triangles: Column, normals: Column | None = None) -> Column:
    return F.struct(vertices.alias("vertices"), (normals if normals is not None else F.lit(None).cast(CLOUD)).alias("normals"), triangles.alias("triangles"))


def mesh_vertex_count(m: Column) -> Column:
    return F.size(m["vertices"])


def mesh_triangle_count(m: Column) -> Column:
    return F.size(m["triangles"])


def mesh_bbox_min(m: Column) -> Column:
    return point_cloud_bbox_min(m["vertices"])


def mesh_bbox_max(m: Column) -> Column:
    return point_cloud_bbox_max(m["vertices"])


def mesh_has_normals(m: Column) -> Column:
    return m["normals"].isNotNull()


def mesh_has_color(m: Column) -> Column:
    return F.lit(False)


mesh_has_uvs = mesh_has_texture = mesh_has_color


def mesh_from_organized(g: Column, jump: float = 0.05) -> Column:
    """Two triangles a cell of the grid; none over a step in depth of more than ``jump`` of the whole range."""

    def run(points, width):
        a, w = [None if p is None else (p["x"], p["y"], p["z"]) for p in points], int(width)
        z = np.array([np.nan if p is None else p[2] for p in a])
        h, limit = len(a) // w, jump * (np.nanmax(z) - np.nanmin(z)) if np.isfinite(z).any() else 0.0
        i = (np.arange(h - 1)[:, None] * w + np.arange(w - 1)).ravel()
        t = np.concatenate([np.stack([i, i + w, i + 1], axis=1), np.stack([i + 1, i + w, i + w + 1], axis=1)])
        span = z[t].max(axis=1) - z[t].min(axis=1)
        return t[span <= limit if limit else np.isfinite(span)].tolist()

    triangles = _mapped("array<array<int>>", run, g["points"], g["width"])
    return mesh(F.transform(g["points"], lambda p: F.coalesce(p, point3d(F.lit(0.0), F.lit(0.0), F.lit(0.0)))), triangles)


def mesh_from_depth_pinhole(depth, width: int, height: int, fov_deg: float) -> Column:
    return mesh_from_organized(point_cloud_from_depth_pinhole(depth, width, height, fov_deg))


def mesh_from_depth_orthographic(depth, width: int, height: int, fov_deg: float) -> Column:
    return mesh_from_organized(point_cloud_from_depth_orthographic(depth, width, height, fov_deg))


def _face_normals(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.cross(v[t[:, 1]] - v[t[:, 0]], v[t[:, 2]] - v[t[:, 0]])


def _triangles(t) -> np.ndarray:
    return np.array([list(x) for x in t], np.int64).reshape(-1, 3)


def mesh_compute_normals(m: Column) -> Column:
    """At each vertex the mean direction of the triangles that meet there, large ones counting more."""

    def run(vertices, triangles):
        v, t = _array(vertices), _triangles(triangles)
        out, faces = np.zeros_like(v), _face_normals(v, t)
        for k in range(3):
            np.add.at(out, t[:, k], faces)
        return _points(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12))

    return mesh(m["vertices"], m["triangles"], _mapped(CLOUD, run, m["vertices"], m["triangles"]))


def mesh_swap_axes(m: Column, axes: list[int]) -> Column:
    """Axes are 1 to 3, negative ones turned round; places and normals alike."""

    def swap(p: Column) -> Column:
        return point3d(*[p["xyz"[abs(a) - 1]] * (1.0 if a > 0 else -1.0) for a in axes])

    return mesh(F.transform(m["vertices"], swap), m["triangles"], F.transform(m["normals"], swap))


def mesh_to_obj(m: Column) -> Column:
    lines = F.transform(m["vertices"], lambda p: F.concat(F.lit("v "), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(" "), p["z"].cast("string")))
    faces = F.transform(m["triangles"], lambda t: F.concat(F.lit("f "), F.array_join(F.transform(t, lambda i: (i + 1).cast("string")), " ")))
    return F.encode(F.concat(F.array_join(F.concat(lines, faces), "\n"), F.lit("\n")), "utf-8")


def mesh_to_stl(m: Column) -> Column:
    def run(vertices, triangles):
        v, t = _array(vertices), _triangles(triangles)
        n = _face_normals(v, t)
        n = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12)
        rows = np.zeros(len(t), np.dtype([("v", "<f4", (4, 3)), ("a", "<u2")]))
        rows["v"] = np.concatenate([n[:, None], v[t]], axis=1)
        return bytes(80) + struct.pack("<I", len(t)) + rows.tobytes()

    return _mapped("binary", run, m["vertices"], m["triangles"])
