"""Hashes, encodings, UUIDs, random draws, paths, assertions, conversions and small generic functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# Hash and encoding


def digest(x, algorithm: str) -> Column:
    c = _c(x)
    name = algorithm.lower().replace("-", "")
    hexed = F.md5(c) if name == "md5" else F.sha1(c) if name == "sha1" else F.sha2(c, int(name.removeprefix("sha")))
    return F.unhex(hexed)


def md5(x) -> Column:
    return F.md5(_c(x))


def sha1(x) -> Column:
    return digest(x, "sha1")


def sha256(x) -> Column:
    return digest(x, "sha256")


def sha384(x) -> Column:
    return digest(x, "sha384")


def sha512(x) -> Column:
    return digest(x, "sha512")


def encode(x, format: str) -> Column:
    """Bytes as text: base64, hex, or escape (octal escapes of what isn't printable)."""
    if format == "base64":
        return F.base64(_c(x))
    if format == "hex":
        return F.lower(F.hex(_c(x)))
    return _ESCAPE(_c(x))


def decode(x, format: str) -> Column:
    return {"base64": F.unbase64, "hex": F.unhex, "escape": lambda c: F.encode(c, "utf-8")}[format](_c(x))


@F.pandas_udf(T.StringType())
def _ESCAPE(s: pd.Series) -> pd.Series:
    return s.map(lambda b: "".join("\\\\" if c == 92 else chr(c) if 32 <= c < 127 else f"\\{c:03o}" for c in b), na_action="ignore")


def hash_split(key, seed: int = 42) -> Column:
    """A uniform number in [0, 1) of a key's bytes; null for a null key.

    Texts count as UTF-8, numbers as the little-endian bytes of their type. Seed 42 stays inside the JVM, where
    numbers of one or two bytes are hashed as four.
    """
    k = _c(key)
    if seed == 42:
        return F.when(k.isNotNull(), (F.shiftrightunsigned(F.xxhash64(k), 41) / F.lit(float(1 << 23))).cast("float"))
    return seeded_split(k.cast("string"), F.typeof(k), F.lit(seed))


#: Formats of the bytes of numbers by type.
_BYTES = {"tinyint": "<b", "smallint": "<h", "int": "<i", "bigint": "<q", "float": "<f", "double": "<d"}


@F.pandas_udf(T.FloatType())
def seeded_split(s: pd.Series, kind: pd.Series, seed: pd.Series) -> pd.Series:
    """Fractions of values given as texts with the names of their types."""
    import struct

    import xxhash

    def raw(v: str, t: str) -> bytes:
        return struct.pack(_BYTES[t], (int if _BYTES[t][1] in "bhiq" else float)(v)) if t in _BYTES else v.encode()

    return pd.Series([None if v is None else (xxhash.xxh64_intdigest(raw(v, t), n) >> 41) / (1 << 23) for v, t, n in zip(s, kind, seed)], dtype="float32")


def cross_validate_fold(k: int, *keys, seed: int = 0) -> Column:
    """Fold numbers 0 to k - 1 by the keys' hash; several keys are joined by a bar."""
    if k < 2:
        raise ValueError("at least two folds")
    key = _c(keys[0]) if len(keys) == 1 else F.concat_ws("|", *[_c(x).cast("string") for x in keys])
    return F.floor(hash_split(key, seed) * k).cast("int")


# UUID


def uuid_extract_version(x) -> Column:
    return F.conv(F.substring(_c(x), 15, 1), 16, 10).cast("short")


def uuid_extract_timestamp(x) -> Column:
    """Of version 7: milliseconds since 1970 in the first twelve digits."""
    millis = F.conv(F.substring(F.replace(_c(x), F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")
    return F.when(uuid_extract_version(x) == 7, F.timestamp_millis(millis))


def uuidv4() -> Column:
    return F.uuid()


def uuidv7() -> Column:
    u = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    head = F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0"))
    return F.concat(F.substring(head, 1, 8), F.lit("-"), F.substring(head, 9, 4), F.lit("-7"), F.substring(u, 14, 3), F.lit("-"), F.substring(u, 17, 4), F.lit("-"), F.substring(u, 21, 12))


def uuid_str(x) -> Column:
    return _c(x).cast("string")


# Random draws


def random(low=None, high=None, seed: int | None = None) -> Column:
    r = F.rand(seed) if seed is not None else F.rand()
    return r if low is None else (low + F.floor(r * (high - low + 1))).cast("long")


def random_boolean(p: float, seed: int | None = None) -> Column:
    return random(seed=seed) < p


def random_exponential(rate: float, seed: int | None = None) -> Column:
    return (-F.ln(1 - random(seed=seed)) / rate).cast("float")


def _normal(seed):
    return F.randn(seed) if seed is not None else F.randn()


def random_normal(mean: float, stddev: float, seed: int | None = None) -> Column:
    return (mean + stddev * _normal(seed)).cast("float")


def random_log_normal(mean: float, stddev: float, seed: int | None = None) -> Column:
    return F.exp(mean + stddev * _normal(seed)).cast("float")


def random_categorical(weights: list[float], seed: int | None = None) -> Column:
    cuts = np.cumsum(weights) / np.sum(weights)
    r = F.array_repeat(random(seed=seed), 1)
    return F.size(F.filter(F.array(*map(F.lit, cuts.tolist())), lambda c: c <= F.get(r, F.lit(0)))).cast("int")


def _drawn(kind: str, draw, seed):
    """Draws by numpy, a batch at a time, seeded by the seed and hashes of the batch's first rows."""

    @F.arrow_udf(kind)
    def run(row: pa.Array) -> pa.Array:
        first = [int(r) & 0xFFFFFFFFFFFFFFFF for r in row.slice(0, 4).to_pylist()]
        v = np.asarray(draw(np.random.default_rng([0 if seed is None else seed, *first]), len(row)), np.int32 if kind == "int" else np.float32)
        if v.ndim == 1:
            return pa.array(v)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))

    row = F.monotonically_increasing_id() if seed is not None else F.floor(F.rand() * (1 << 31))
    return run(F.xxhash64(row))


def random_beta(alpha: float, beta: float, seed: int | None = None) -> Column:
    return _drawn("float", lambda g, n: g.beta(alpha, beta, n), seed)


def random_poisson(lam: float, seed: int | None = None) -> Column:
    return _drawn("int", lambda g, n: g.poisson(lam, n), seed)


def random_truncated_normal(mean: float, stddev: float, low: float, high: float, seed: int | None = None) -> Column:
    def draw(g, n):
        out, left = np.empty(n), np.arange(n)
        while len(left):
            out[left] = g.normal(mean, stddev, len(left))
            left = left[~((out[left] >= low) & (out[left] <= high))]
        return out

    return _drawn("float", draw, seed)


def random_vector(length: int, seed: int | None = None) -> Column:
    return _drawn("array<float>", lambda g, n: g.random((n, length)), seed)


def random_normal_vector(length: int, mean: float, stddev: float, seed: int | None = None) -> Column:
    return _drawn("array<float>", lambda g, n: g.normal(mean, stddev, (n, length)), seed)


# Paths


def get_directory(x) -> Column:
    return F.regexp_extract(_c(x), r"^(.*)[/\\]", 1)


def get_filename(x) -> Column:
    return F.regexp_extract(_c(x), r"[^/\\]*$", 0)


def get_filename_ext(x) -> Column:
    return F.regexp_extract(get_filename(x), r"(\.[^.]*)$", 1)


def get_filename_no_ext(x) -> Column:
    return F.regexp_replace(get_filename(x), r"\.[^.]*$", "")


def change_filename_ext(x, extension: str) -> Column:
    return F.concat(F.regexp_replace(_c(x), r"\.[^./\\]*$", ""), F.lit("." + extension.lstrip(".")))


def path_concat(*parts) -> Column:
    return F.concat_ws("/", *[F.regexp_replace(_c(p), r"[/\\]+$", "") for p in parts])


# Conversion


def try_cast(x, kind: str) -> Column:
    return _c(x).try_cast(kind)


def can_cast(x, kind: str) -> Column:
    return _c(x).isNull() | _c(x).try_cast(kind).isNotNull()


def wrap_cast(x, kind: str) -> Column:
    """Whole numbers wrap to a narrower kind."""
    bits = {"tinyint": 8, "byte": 8, "smallint": 16, "short": 16, "int": 32, "integer": 32}[kind]
    half = 1 << (bits - 1)
    return (F.pmod(_c(x).cast("long") + half, F.lit(1 << bits)) - half).cast(kind)


cast = lambda x, kind: _c(x).cast(kind)
coalesce, nullif, typeof = F.coalesce, F.nullif, F.typeof


def current_setting(spark, name: str) -> str:
    return spark.conf.get({"timezone": "spark.sql.session.timeZone"}.get(name.lower(), name))


# JSON


def json_parse(x) -> Column:
    return F.parse_json(_c(x))


def json_try_parse(x) -> Column:
    return F.try_parse_json(_c(x))


def json_value(x, path: str, kind: str = "string") -> Column:
    """A scalar at a path, or null; x is a parsed document."""
    return F.try_variant_get(_c(x), path, kind)


def json_query(x, path: str) -> Column:
    """An object or array at a path, or null."""
    v = F.try_variant_get(_c(x), path, "variant")
    return F.when(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), v)


def json_to_text(x) -> Column:
    return F.to_json(_c(x))


# Assertions: the value itself, or an error. A null passes, but for assert_not_null and assert_non_empty.


def _checked(x, good: Column, message: str) -> Column:
    c = _c(x)
    return F.when(F.coalesce(good, F.lit(True)), c).otherwise(F.raise_error(F.lit(message)).cast("string"))


def _assertion(test):
    return lambda x, *args, message="assertion failed": _checked(x, test(_c(x), *args), message)


assert_between = _assertion(lambda c, low, high: c.between(low, high))
assert_ends_with = _assertion(lambda c, s: c.endswith(s))
assert_starts_with = _assertion(lambda c, s: c.startswith(s))
assert_equal = _assertion(lambda c, v: c == v)
assert_not_equal = _assertion(lambda c, v: c != v)
assert_false = _assertion(lambda c: ~c)
assert_true = _assertion(lambda c: c)
assert_finite = _assertion(lambda c: ~F.isnan(c) & (F.abs(c) != float("inf")))
assert_greater_or_equal = _assertion(lambda c, v: c >= v)
assert_greater_than = _assertion(lambda c, v: c > v)
assert_less_or_equal = _assertion(lambda c, v: c <= v)
assert_less_than = _assertion(lambda c, v: c < v)
assert_in = _assertion(lambda c, values: c.isin(list(values)))
assert_not_in = _assertion(lambda c, values: ~c.isin(list(values)))
assert_length = _assertion(lambda c, n: F.char_length(c) == n)
assert_matches = _assertion(lambda c, p: c.rlike(p))
assert_non_empty = _assertion(lambda c: F.coalesce(F.char_length(c) > 0, F.lit(False)))
assert_not_null = _assertion(lambda c: c.isNotNull())
assert_non_negative = _assertion(lambda c: c >= 0)
assert_positive = _assertion(lambda c: c > 0)


# Easing, colours and geometry of points; poses are matrices of 4 by 4, row by row, that map to the world.


def lerp(t, low: float, high: float) -> Column:
    return low + (high - low) * _c(t)


def oscillate(t, low: float, high: float, frequency: float = 1.0) -> Column:
    """A sine about the middle of the range, from the middle upwards."""
    return low + (high - low) * (0.5 + 0.5 * F.sin(2 * F.pi() * frequency * _c(t)))


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def fade_in(t, duration: float = 0.25) -> Column:
    """From 0 to 1 in the first ``duration``."""
    return _unit(_c(t) / duration)


def fade_out(t, duration: float = 0.25) -> Column:
    """From 1 to 0 in the last ``duration``."""
    return _unit((1 - _c(t)) / duration)


# The arcs of the usual ease-out bounce, as (end, centre, floor), over a width of 2.75.
BOUNCE = ((1.0, 0.0, 0.0), (2.0, 1.5, 0.75), (2.5, 2.25, 0.9375), (None, 2.625, 0.984375))


def bounce(t, low: float, high: float, bounces: int = 3) -> Column:
    """Three bounces are the usual ease-out curve; another number is a cosine that dies down."""
    x = _unit(_c(t))
    if bounces == 3:
        at = F.coalesce(*[(F.when(x * 2.75 < end, F.lit(1.0)) if end else F.lit(1.0)) * (7.5625 * F.pow(x - mid / 2.75, F.lit(2.0)) + base) for end, mid, base in BOUNCE])
    else:
        at = 1 - F.abs(F.cos(F.pi() * bounces * x)) * (1 - x)
    return low + (high - low) * at


def wobble(t, low: float, high: float, seed: int = 0) -> Column:
    """Three sines of one, two and four turns whose phases the seed sets."""
    phase = np.random.default_rng(seed).random(3) * 2 * np.pi
    wave = sum((F.sin(2 * F.pi() * k * _c(t) + float(p)) / k for k, p in zip((1, 2, 4), phase)), F.lit(0.0)) / 1.75
    return low + (high - low) * (0.5 + 0.5 * wave)


def random_walk(t, low: float, high: float, steps: int = 10, seed: int = 0) -> Column:
    """A walk between the bounds that the seed fixes, with straight lines between its steps."""
    walk = np.cumsum(np.random.default_rng(seed).choice([-1.0, 1.0], steps))
    walk = np.concatenate([[0.0], walk])
    walk = (walk - walk.min()) / max(walk.max() - walk.min(), 1.0)
    known, x = F.array(*map(F.lit, walk.tolist())), _unit(_c(t)) * steps
    i = F.least(F.floor(x).cast("int"), F.lit(steps - 1))
    return low + (high - low) * (F.get(known, i) + (F.get(known, i + 1) - F.get(known, i)) * (x - i))


# Colours are structs of four bytes.


def color(r, g, b, a=255) -> Column:
    return F.struct(*[F.round(F.least(F.greatest(_c(v), F.lit(0)), F.lit(255))).cast("int").alias(k) for k, v in zip("rgba", (r, g, b, a))])


def color_hex(x) -> Column:
    """#rgb, #rgba, #rrggbb or #rrggbbaa, the sign left out at will; null for anything else."""
    h = F.lower(F.regexp_replace(_c(x), "^#", ""))
    wide = F.when(F.length(h) <= 4, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    full = F.when(F.length(wide) == 6, F.concat(wide, F.lit("ff"))).otherwise(wide)
    parts = [F.conv(F.substring(full, 2 * i + 1, 2), 16, 10).cast("int").alias(k) for i, k in enumerate("rgba")]
    return F.when(h.rlike("^([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$"), F.struct(*parts))


def color_interpolate(a: Column, b: Column, t) -> Column:
    return F.struct(*[F.round(a[k] + (b[k] - a[k]) * _unit(_c(t))).cast("int").alias(k) for k in "rgba"])


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres on a sphere of radius 6,371,000."""
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * 6_371_000.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def point2d(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def point3d(x, y, z) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"), _c(z).cast("double").alias("z"))


def distance_sq(a: Column, b: Column, dims: int = 3) -> Column:
    out = F.lit(0.0)
    for d in "xyz"[:dims]:
        out = out + (a[d] - b[d]) * (a[d] - b[d])
    return out


def distance(a: Column, b: Column, dims: int = 3) -> Column:
    return F.sqrt(distance_sq(a, b, dims))


def point_x(p: Column) -> Column:
    return p["x"]


def point_y(p: Column) -> Column:
    return p["y"]


def point_z(p: Column) -> Column:
    return p["z"]


def _matrix(values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values])


def pose_identity() -> Column:
    return _matrix([1.0 if i % 5 == 0 else 0.0 for i in range(16)])


def pose_translate(dx, dy, dz) -> Column:
    moved = {3: dx, 7: dy, 11: dz}
    return _matrix([_c(moved[i]).cast("double") if i in moved else 1.0 if i % 5 == 0 else 0.0 for i in range(16)])


def _cell(m: Column, row: int, column: int) -> Column:
    return F.get(m, F.lit(4 * row + column)).cast("double")


def pose_compose(a: Column, b: Column) -> Column:
    """The matrix product: b is applied first."""
    return _matrix([sum((_cell(a, i, k) * _cell(b, k, j) for k in range(4)), F.lit(0.0)) for i in range(4) for j in range(4)])


def pose_inverse(p: Column) -> Column:
    """Of a rotation and a translation."""
    rows = []
    for i in range(3):
        turned = [_cell(p, k, i) for k in range(3)]
        rows += [*turned, -(turned[0] * _cell(p, 0, 3) + turned[1] * _cell(p, 1, 3) + turned[2] * _cell(p, 2, 3))]
    return _matrix([*rows, 0.0, 0.0, 0.0, 1.0])


def pose_to_world_position(p: Column) -> Column:
    return point3d(*[_cell(p, i, 3) for i in range(3)])


def pose_to_euler_degrees(p: Column) -> Column:
    """Yaw, pitch and roll about y, x and z, turned in that order; straight up or down there is no roll."""
    sine = F.least(F.greatest(-_cell(p, 1, 2), F.lit(-1.0)), F.lit(1.0))
    steep = F.abs(sine) > 0.99999
    yaw = F.when(steep, F.atan2(-_cell(p, 2, 0), _cell(p, 0, 0))).otherwise(F.atan2(_cell(p, 0, 2), _cell(p, 2, 2)))
    roll = F.when(steep, F.lit(0.0)).otherwise(F.atan2(_cell(p, 1, 0), _cell(p, 1, 1)))
    return F.array(F.degrees(yaw), F.degrees(F.asin(sine)), F.degrees(roll))


def pc_transform(cloud: Column, pose: Column) -> Column:
    """An array of points moved by a pose."""

    def move(p):
        return point3d(*[_cell(pose, i, 0) * p["x"] + _cell(pose, i, 1) * p["y"] + _cell(pose, i, 2) * p["z"] + _cell(pose, i, 3) for i in range(3)])

    return F.transform(cloud, move)


def _coordinate(name: str):
    return lambda p: p[name]


def point_cloud_count(cloud: Column) -> Column:
    return F.size(cloud)


def point_cloud_bbox_min(cloud: Column) -> Column:
    return point3d(*[F.array_min(F.transform(cloud, _coordinate(d))) for d in "xyz"])


def point_cloud_bbox_max(cloud: Column) -> Column:
    return point3d(*[F.array_max(F.transform(cloud, _coordinate(d))) for d in "xyz"])


def pc_filter_depth(cloud: Column, low: float, high: float) -> Column:
    return F.filter(cloud, lambda p: p["z"].between(low, high))


def pc_fuse(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def pc_voxel_downsample(cloud: Column, cell: float) -> Column:
    """One point for each cell that has any: the centre of its points."""
    from .mesh import pc_voxel_consensus

    return pc_voxel_consensus(cloud, cell, 1)


# The published channel means and deviations.
IMAGENET_MEAN, IMAGENET_STD = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]


def imagenet_mean() -> Column:
    return F.array(*map(F.lit, IMAGENET_MEAN))


def imagenet_std() -> Column:
    return F.array(*map(F.lit, IMAGENET_STD))
