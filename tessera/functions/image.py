"""Images as binary columns: a head of width, height and channels, then the samples row by row.

The head is ``TIMG`` and three big-endian integers of four bytes, so sizes are read inside the JVM; what touches
samples runs in Arrow batches with numpy. Files are PNG (any depth of 8 bits, not interlaced), BMP and PPM/PGM.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

HEAD = struct.Struct(">4sIII")
# Luma weights of BT.601 and the published channel means and deviations.
LUMA = np.array([0.299, 0.587, 0.114])
# Rows of an Arrow batch, the bytes of results that one may hold, and those of the parts of larger ones.
ROWS, BATCH, PART = 10_000, 1 << 28, 1 << 23
CLIP_MEAN, CLIP_STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def pack(a: np.ndarray) -> bytes:
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8) if a.dtype != np.uint8 else a
    a = a[:, :, None] if a.ndim == 2 else a
    return HEAD.pack(b"TIMG", a.shape[1], a.shape[0], a.shape[2]) + np.ascontiguousarray(a).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    _, w, h, c = HEAD.unpack_from(raw)
    return np.frombuffer(raw, np.uint8, w * h * c, HEAD.size).reshape(h, w, c)


def rgb(a: np.ndarray) -> np.ndarray:
    return np.repeat(a[:, :, :1], 3, axis=2) if a.shape[2] < 3 else a[:, :, :3]


def rgba(a: np.ndarray) -> np.ndarray:
    if a.shape[2] == 4:
        return a
    alpha = a[:, :, 1:2] if a.shape[2] == 2 else np.full((*a.shape[:2], 1), 255, np.uint8)
    return np.concatenate([rgb(a), alpha], axis=2)


def luma(a: np.ndarray) -> np.ndarray:
    return a[:, :, 0].astype(float) if a.shape[2] < 3 else a[:, :, :3].astype(float) @ LUMA


def _keeping_alpha(a: np.ndarray, colours: np.ndarray) -> np.ndarray:
    colours = np.clip(np.rint(colours), 0, 255).astype(np.uint8)
    return np.concatenate([colours, a[:, :, 3:]], axis=2) if a.shape[2] == 4 else colours


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray, outside: float | None = None) -> np.ndarray:
    """Bilinear samples at fractional places; beyond the edge the edge, or ``outside``."""
    h, w = a.shape[:2]
    yc, xc = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(yc).astype(int), np.floor(xc).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (yc - y0)[..., None], (xc - x0)[..., None]
    v = a.astype(float)
    out = (v[y0, x0] * (1 - fx) + v[y0, x1] * fx) * (1 - fy) + (v[y1, x0] * (1 - fx) + v[y1, x1] * fx) * fy
    if outside is not None:
        out[(y < -0.5) | (y > h - 0.5) | (x < -0.5) | (x > w - 0.5)] = outside
    return out


def stretch(a: np.ndarray, w: int, h: int) -> np.ndarray:
    y, x = (np.arange(h) + 0.5) * a.shape[0] / h - 0.5, (np.arange(w) + 0.5) * a.shape[1] / w - 0.5
    return sample(a, np.repeat(y[:, None], w, axis=1), np.repeat(x[None], h, axis=0))


# Files


def read_png(raw: bytes) -> np.ndarray:
    w, h, depth, kind, _, _, interlaced = struct.unpack_from(">IIBBBBB", raw, 16)
    if depth != 8 or interlaced:
        raise ValueError("a PNG of 8 bits a sample, not interlaced, is needed")
    body, palette, clear, at = b"", None, b"", 8
    while at < len(raw):
        size, name = struct.unpack_from(">I4s", raw, at)
        part = raw[at + 8 : at + 8 + size]
        body, palette, clear = body + part if name == b"IDAT" else body, part if name == b"PLTE" else palette, part if name == b"tRNS" else clear
        at += 12 + size
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.int64)
    for i in range(h):
        f, line = int(rows[i, 0]), rows[i, 1:].astype(np.int64)
        if f == 1:
            line = np.cumsum(line.reshape(w, c), axis=0).ravel()
        elif f == 2:
            line = line + above
        elif f in (3, 4):
            for k in range(w * c):
                left, corner = (line[k - c], above[k - c]) if k >= c else (0, 0)
                if f == 3:
                    line[k] = (line[k] + (left + above[k]) // 2) & 255
                else:
                    guess = left + above[k] - corner
                    by = (abs(guess - left), abs(guess - above[k]), abs(guess - corner))
                    line[k] = (line[k] + (left, above[k], corner)[by.index(min(by))]) & 255
        above = line & 255
        out[i] = above
    a = out.reshape(h, w, c)
    if kind == 3:
        table = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        alpha = np.concatenate([np.frombuffer(clear, np.uint8), np.full(len(table) - len(clear), 255, np.uint8)])[:, None]
        a = np.concatenate([table, alpha], axis=1)[a[:, :, 0]] if clear else table[a[:, :, 0]]
    return a


def write_png(a: np.ndarray) -> bytes:
    h, w, c = a.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * c)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read_bmp(raw: bytes) -> np.ndarray:
    at, (w, h), bits = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<ii", raw, 18), struct.unpack_from("<H", raw, 28)[0]
    c, stride = bits // 8, (w * bits // 8 + 3) // 4 * 4
    a = np.frombuffer(raw, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * c].reshape(abs(h), w, c)
    a = a[::-1] if h > 0 else a
    return a[:, :, [2, 1, 0, 3][:c]] if c >= 3 else a


def write_bmp(a: np.ndarray) -> bytes:
    a = rgb(a)[::-1, :, ::-1]
    h, w = a.shape[:2]
    lines = np.pad(a.reshape(h, w * 3), ((0, 0), (0, -w * 3 % 4))).tobytes()
    return struct.pack("<2sIHHI", b"BM", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(lines), 2835, 2835, 0, 0) + lines


def read_pnm(raw: bytes) -> np.ndarray:
    kind, w, h, _ = raw.split(maxsplit=4)[:4]
    c = {b"P5": 1, b"P6": 3}[kind]
    return np.frombuffer(raw[-int(w) * int(h) * c :], np.uint8).reshape(int(h), int(w), c)


def decode(raw) -> np.ndarray:
    if isinstance(raw, np.ndarray):
        return raw
    if raw[:4] == b"\x89PNG":
        return read_png(raw)
    if raw[:2] == b"BM":
        return read_bmp(raw)
    if raw[:2] in (b"P5", b"P6"):
        return read_pnm(raw)
    raise ValueError("neither PNG, BMP nor PPM")


def encode(a: np.ndarray, format: str) -> bytes:
    if format == "ppm":
        return b"P6\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(rgb(a)).tobytes()
    return {"png": write_png, "bmp": write_bmp}[format.lower()](a)


def write_gif(frames: list[np.ndarray], fps: float) -> bytes:
    """A looping GIF on a cube of 6 by 6 by 6 colours, with codes that are cleared before they grow."""
    h, w = frames[0].shape[:2]
    table = b"".join(bytes((51 * r, 51 * g, 51 * b)) for r in range(6) for g in range(6) for b in range(6)) + bytes(3 * 40)
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), table, b"!\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for a in frames:
        q = (rgb(a).astype(int) + 25) // 51
        codes = (q[:, :, 0] * 36 + q[:, :, 1] * 6 + q[:, :, 2]).ravel()
        groups = [np.concatenate([[256], codes[i : i + 254]]) for i in range(0, len(codes), 254)]  # of 9 bits each
        bits = (np.concatenate([*groups, [257]])[:, None] >> np.arange(9)) & 1
        body = np.packbits(bits.ravel().astype(np.uint8), bitorder="little").tobytes()
        blocks = b"".join(bytes((len(body[i : i + 255]),)) + body[i : i + 255] for i in range(0, len(body), 255))
        out += [b"!\xf9\x04\x00", struct.pack("<H", round(100 / fps)), b"\x00\x00", b",", struct.pack("<HHHHB", 0, 0, w, h, 0), b"\x08", blocks, b"\x00"]
    return b"".join([*out, b";"])


# Columns


def _joined(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row, the same for rows whose codes are the same in all columns."""
    out = columns[0]
    for c in columns[1:]:
        out = (out + 1) * (int(c.max(initial=0)) + 2) + c + 1
        out = pa.array(out).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(int)
    return out


def _codes(a: pa.Array) -> np.ndarray:
    """A number for each row, the same for equal values, -1 for a null."""
    if pa.types.is_list(a.type):
        ends = np.concatenate([[0], np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
        flat = a.flatten()
        plain = pa.types.is_floating(flat.type) or pa.types.is_integer(flat.type)
        v = flat.to_numpy(zero_copy_only=False) if plain and not flat.null_count else _codes(flat)
        raw, wide, places = v.tobytes(), v.itemsize, {}
        codes = [places.setdefault(raw[i * wide : j * wide], len(places)) for i, j in zip(ends[:-1], ends[1:])]
    elif pa.types.is_struct(a.type):
        codes = _joined([_codes(x) for x in a.flatten()])
    else:
        v = a.view(f"int{a.type.bit_width}") if pa.types.is_floating(a.type) else a
        codes = v.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    codes = np.array(codes, int)
    codes[a.is_null().to_numpy(zero_copy_only=False)] = -1
    return codes


def _mapped(kind: str, f, *columns, size: int = 0) -> Column:
    """A function of numpy images and plain values over columns; a null in any gives null.

    Rows of a batch with equal values are worked out once. With results of ``size`` bytes a row, of which a batch would
    hold more than BATCH, they are worked out and sent on in parts.
    """
    goal = to_arrow_type(DataType.fromDDL(kind))

    def one(values):
        out = f(*[unpack(v) if isinstance(v, (bytes, bytearray)) and v[:4] == b"TIMG" else v for v in values])
        out = pack(out) if kind == "binary" and isinstance(out, np.ndarray) else out
        return np.asarray(out, np.float32) if kind == "array<float>" and out is not None else out

    def results(given) -> pa.Array:
        _, first, at = np.unique(_joined([_codes(a) for a in given]), return_index=True, return_inverse=True)
        known = np.all([a.is_valid().to_numpy(zero_copy_only=False)[first] for a in given], axis=0)
        rows = zip(*[a.take(pa.array(first[known])).to_pandas().tolist() for a in given])
        made = [one(next(rows)) if k else None for k in known]
        return pa.array(made, goal).take(pa.array(at.ravel()))

    def whole(first: pa.Array, *rest: pa.Array) -> pa.Array:
        return results([first, *rest])

    def parts(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        rows = max(1, PART // size)
        for batch in batches:
            given = batch if isinstance(batch, tuple) else (batch,)  # a lone column comes bare
            for i in range(0, len(given[0]), rows):
                yield results([a.slice(i, rows) for a in given])

    run = F.arrow_udf(parts if size * ROWS > BATCH else whole, kind)
    return run(*map(_c, columns))


def image(f, *columns, size: int = 0) -> Column:
    return _mapped("binary", f, *columns, size=size)


def image_decode(x) -> Column:
    return image(decode, x)


def image_encode(img, format: str = "png") -> Column:
    return _mapped("binary", lambda a: encode(a, format), img)


def _head(img, at: int) -> Column:
    return F.conv(F.hex(F.substring(_c(img), at, 4)), 16, 10).cast("int")


def image_width(img) -> Column:
    return _head(img, 5)


def image_height(img) -> Column:
    return _head(img, 9)


def image_channels(img) -> Column:
    return _head(img, 13)


def pixel_count(img) -> Column:
    return image_width(img) * image_height(img)


def dimensions(img, format: str) -> Column:
    return F.array(*[{"W": image_width, "H": image_height, "C": image_channels}[k](img) for k in format.upper()])


def create_image_rgb(width, height, r, g, b) -> Column:
    def made(w, h, *c):
        return np.broadcast_to(np.array([*map(int, c), 255], np.uint8), (int(h), int(w), 4))

    return image(made, *[x if isinstance(x, Column) else F.lit(x) for x in (width, height, r, g, b)])


def image_to_bytes(img) -> Column:
    """Samples of red, green, blue and alpha on end."""
    return _mapped("binary", lambda a: np.ascontiguousarray(rgba(a)).tobytes(), img)


def brighten(img, amount: float) -> Column:
    return image(lambda a: _keeping_alpha(a, rgb(a) + float(amount)), img)


def darken(img, amount: float) -> Column:
    return brighten(img, -amount)


def grayscale(img) -> Column:
    return image(lambda a: _keeping_alpha(a, np.repeat(luma(a)[:, :, None], 3, axis=2)), img)


def image_brightness_mean(img) -> Column:
    return _mapped("double", lambda a: float(luma(a).mean()), img)


def image_brightness_std(img) -> Column:
    return _mapped("double", lambda a: float(luma(a).std()), img)


def image_brightness_histogram(img) -> Column:
    return _mapped("array<float>", lambda a: np.bincount(np.clip(np.rint(luma(a)), 0, 255).astype(int).ravel(), minlength=256).astype(np.float32), img)


def image_pixel_mean(img, channels: list[int] | None = None) -> Column:
    if channels is None:
        return _mapped("double", lambda a: float(rgb(a).mean()), img)
    return _mapped("array<float>", lambda a: rgba(a).mean(axis=(0, 1))[channels], img)


def image_pixel_std(img, channels: list[int] | None = None) -> Column:
    if channels is None:
        return _mapped("double", lambda a: float(rgb(a).astype(float).std()), img)
    return _mapped("array<float>", lambda a: rgba(a).astype(float).std(axis=(0, 1))[channels], img)


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Smoothed along both axes; the edge goes on."""
    if sigma <= 0:
        return a.astype(float)
    n = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    k /= k.sum()
    out = a.astype(float)
    for axis in (0, 1):
        wide = np.pad(out, [(n, n) if i == axis else (0, 0) for i in range(out.ndim)], mode="edge")
        out = sum(k[i] * np.take(wide, np.arange(i, i + out.shape[axis]), axis=axis) for i in range(2 * n + 1))
    return out


def blur(img, radius: float) -> Column:
    return image(lambda a: gaussian(a, radius), img)


def detect_blur(img) -> Column:
    """Variance of the Laplacian of the luma."""

    def variance(a):
        y = luma(a)
        if min(y.shape) < 3:
            return 0.0
        return float((y[:-2, 1:-1] + y[2:, 1:-1] + y[1:-1, :-2] + y[1:-1, 2:] - 4 * y[1:-1, 1:-1]).var())

    return _mapped("double", variance, img)


def compression_artifact_score(img) -> Column:
    """How far steps over the borders of 8 by 8 blocks exceed the other steps, from 0 to 1."""

    def score(a):
        y, parts = luma(a), []
        for m in (y, y.T):
            d = np.abs(np.diff(m, axis=1))
            edge = np.arange(d.shape[1]) % 8 == 7
            if edge.any() and (~edge).any():
                at, within = d[:, edge].mean(), d[:, ~edge].mean()
                parts.append(max(0.0, at - within) / (at + within) if at + within else 0.0)
        return float(np.mean(parts)) if parts else 0.0

    return _mapped("double", score, img)


def sobel(img) -> Column:
    """Strength of edges; a border of one pixel is black."""

    def edges(a):
        y, out = luma(a), np.zeros(a.shape[:2])
        if min(y.shape) >= 3:
            across = y[:, 2:] - y[:, :-2]
            down = y[2:] - y[:-2]
            gx = across[:-2] + 2 * across[1:-1] + across[2:]
            gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
            out[1:-1, 1:-1] = np.hypot(gx, gy)
        return rgba(np.clip(out, 0, 255).astype(np.uint8)[:, :, None])

    return image(edges, img)


def perceptual_hash(img) -> Column:
    """64 bits: of 9 by 8 lumas, whether each exceeds the one to its right."""

    def bits(a):
        y = np.round(stretch(luma(a)[:, :, None], 9, 8)[:, :, 0], 6)
        return (y[:, :-1] > y[:, 1:]).astype(np.float32).ravel()

    return _mapped("array<float>", bits, img)


def image_composite_over(img, background: list[float]) -> Column:
    def over(a):
        f = rgba(a).astype(float)
        alpha = f[:, :, 3:] / 255
        return rgba(np.rint(f[:, :, :3] * alpha + np.array(background, float) * (1 - alpha)).astype(np.uint8))

    return image(over, img)


def image_concat(a, b, direction: str = "horizontal") -> Column:
    axis = 1 if direction[0] == "h" else 0

    def joined(x, y):
        x, y = rgba(x), rgba(y)
        side = max(x.shape[1 - axis], y.shape[1 - axis])
        fit = lambda m: np.pad(m, [(0, side - m.shape[i]) if i == 1 - axis else (0, 0) for i in range(3)])
        return np.concatenate([fit(x), fit(y)], axis=axis)

    return image(joined, a, b)


def crop(a: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
    x, y = max(0, int(x)), max(0, int(y))
    return a[y : y + max(1, int(h)), x : x + max(1, int(w))]


def image_crop(img, x: float, y: float, w: float, h: float) -> Column:
    return image(lambda a: crop(a, x, y, w, h), img)


def image_cutout(img, mask) -> Column:
    """The mask's red becomes the alpha; it is stretched where sizes differ."""

    def cut(a, m):
        alpha = m[:, :, 0] if m.shape[:2] == a.shape[:2] else np.rint(stretch(m[:, :, :1], a.shape[1], a.shape[0]))[:, :, 0].astype(np.uint8)
        return np.dstack([rgb(a), alpha])

    return image(cut, img, mask)


def image_multiply(img, mask) -> Column:
    def times(a, m):
        m = m[:, :, :1] if m.shape[:2] == a.shape[:2] else stretch(m[:, :, :1], a.shape[1], a.shape[0])
        return _keeping_alpha(a, rgb(a) * (m / 255.0))

    return image(times, img, mask)


def image_transpose(img) -> Column:
    return image(lambda a: a.transpose(1, 0, 2), img)


def resize(img, width: int, height: int, mode: str = "bilinear") -> Column:
    def sized(a):
        if mode == "nearest":
            return a[(np.arange(height) * a.shape[0] // height)][:, (np.arange(width) * a.shape[1] // width)]
        return stretch(a, width, height)

    return image(sized, img, size=4 * width * height)


def image_resize_to_stride(img, max_side: int, stride: int) -> Column:
    def sized(a):
        h, w = a.shape[:2]
        k = min(1.0, max_side / max(h, w))
        near = lambda n: max(stride, int(round(n * k / stride)) * stride)
        return stretch(a, near(w), near(h))

    return image(sized, img)


def image_resize_and_crop(img, width: int, height: int, gravity: str = "center") -> Column:
    """Resized to fill the frame; gravity names the part of the excess that is kept."""

    def sized(a):
        k = max(width / a.shape[1], height / a.shape[0])
        w, h = max(width, round(a.shape[1] * k)), max(height, round(a.shape[0] * k))
        x = 0 if "left" in gravity or "west" in gravity else w - width if "right" in gravity or "east" in gravity else (w - width) // 2
        y = 0 if "top" in gravity or "north" in gravity else h - height if "bottom" in gravity or "south" in gravity else (h - height) // 2
        return stretch(a, w, h)[y : y + height, x : x + width]

    return image(sized, img, size=4 * width * height)


def image_resize_foreground(img, ratio: float) -> Column:
    """The box of pixels that aren't transparent, in the middle of a square of which it takes ``ratio``."""

    def framed(a):
        a = rgba(a)
        ys, xs = np.nonzero(a[:, :, 3])
        box = a[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] if len(ys) else a
        side = max(1, int(round(max(box.shape[:2]) / ratio)))
        out = np.zeros((side, side, 4), np.uint8)
        y, x = (side - box.shape[0]) // 2, (side - box.shape[1]) // 2
        out[y : y + box.shape[0], x : x + box.shape[1]] = box
        return out

    return image(framed, img)


def _warped(a: np.ndarray, back: np.ndarray, w: int, h: int, transparent: bool) -> np.ndarray:
    """An image seen through the matrix that takes places of the result back to the source."""
    y, x = np.mgrid[0:h, 0:w]
    p = np.tensordot(back, np.stack([x, y, np.ones_like(x)]).astype(float), axes=1)
    depth = p[2] if back.shape[0] == 3 else 1.0
    return sample(rgba(a) if transparent else a, p[1] / depth, p[0] / depth, 0.0 if transparent else None)


def affine_transform(img, angle: float, scale_x: float = 1.0, scale_y: float = 1.0, shear_x: float = 0.0, shear_y: float = 0.0) -> Column:
    """Rotated by degrees, scaled and sheared about the middle, on a canvas of the same size."""

    def turned(a):
        h, w = a.shape[:2]
        t = np.radians(angle)
        m = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) @ np.array([[1, shear_x], [shear_y, 1]]) @ np.diag([scale_x, scale_y])
        inv, mid = np.linalg.inv(m), np.array([(w - 1) / 2, (h - 1) / 2])
        return _warped(a, np.column_stack([inv, mid - inv @ mid]), w, h, True)

    return image(turned, img)


def rotate(img, degrees: float) -> Column:
    """Clockwise; the canvas grows to hold the corners, and what is new is transparent."""

    def turned(a):
        if degrees % 90 == 0:
            return np.rot90(a, -int(degrees // 90))
        t = np.radians(degrees)
        m = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        h, w = a.shape[:2]
        size = np.abs(m) @ np.array([w, h])
        nw, nh = int(np.ceil(size[0])), int(np.ceil(size[1]))
        inv = m.T
        shift = np.array([(w - 1) / 2, (h - 1) / 2]) - inv @ np.array([(nw - 1) / 2, (nh - 1) / 2])
        return _warped(a, np.column_stack([inv, shift]), nw, nh, True)

    return image(turned, img)


def directional_warp(img, dx: float, dy: float, intensity: float) -> Column:
    """A shear along a direction: nothing moves in the middle, and ``intensity`` pixels at the far edges."""

    def sheared(a):
        h, w = a.shape[:2]
        d = np.array([dx, dy], float) / max(np.hypot(dx, dy), 1e-9)
        y, x = np.mgrid[0:h, 0:w].astype(float)
        across = -(x - (w - 1) / 2) * d[1] + (y - (h - 1) / 2) * d[0]
        k = intensity * across / max(np.abs(across).max(), 1e-9)
        return sample(rgba(a), y - k * d[1], x - k * d[0], 0.0)

    return image(sheared, img)


def elastic_deform(img, alpha: float, sigma: float, seed: int = 0) -> Column:
    def moved(a):
        h, w = a.shape[:2]
        field = np.random.default_rng(seed).uniform(-1, 1, (h, w, 2))
        field = gaussian(field, sigma) * alpha
        y, x = np.mgrid[0:h, 0:w].astype(float)
        return sample(a, y + field[:, :, 0], x + field[:, :, 1])

    return image(moved, img)


def perspective_warp(img, intensity: float | None = None, corners: list[float] | None = None, seed: int = 0) -> Column:
    """Corners (top left, top right, bottom left, bottom right; x then y, from 0 to 1) that the image is drawn to."""

    def bent(a):
        h, w = a.shape[:2]
        base = np.array([0, 0, 1, 0, 0, 1, 1, 1], float)
        goal = np.array(corners, float) if corners is not None else base + np.random.default_rng(seed).uniform(-intensity, intensity, 8)
        frame = np.tile([w - 1, h - 1], 4)
        src, dst = (base * frame).reshape(4, 2), (goal * frame).reshape(4, 2)
        rows = [r for (x, y), (u, v) in zip(dst, src) for r in ([x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y])]
        back = np.append(np.linalg.solve(np.array(rows), src.ravel()), 1.0).reshape(3, 3)
        return _warped(a, back, w, h, True)

    return image(bent, img)


def noise(img, value: float, kind: str = "gaussian", seed: int = 0) -> Column:
    def noisy(a):
        g = np.random.default_rng([seed, zlib.crc32(a.tobytes())])
        c = rgb(a).astype(float)
        if kind == "gaussian":
            return _keeping_alpha(a, c + g.normal(0, value, c.shape))
        hit = g.random(c.shape[:2])
        c[hit < value / 2], c[hit > 1 - value / 2] = 0, 255
        return _keeping_alpha(a, c)

    return image(noisy, img)


# The published polynomial of the turbo palette, by channel, lowest power first.
TURBO = ((0.13572138, 4.6153926, -42.66032258, 132.13108234, -152.94239396, 59.28637943), (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604), (0.1066733, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973))


def apply_colormap(img, palette: str = "turbo") -> Column:
    def painted(a):
        t = a[:, :, 0] / 255.0
        if palette == "gray":
            c = np.repeat(t[:, :, None], 3, axis=2)
        elif palette == "jet":
            c = np.stack([np.clip(1.5 - np.abs(4 * t - k), 0, 1) for k in (3, 2, 1)], axis=2)
        else:
            c = np.stack([np.clip(np.polyval(p[::-1], t), 0, 1) for p in TURBO], axis=2)
        return rgba(np.rint(c * 255).astype(np.uint8))

    return image(painted, img)


def _normalised(v: np.ndarray, invert: bool) -> np.ndarray:
    v = np.where(np.isfinite(v), v, np.nan)
    low, high = np.nanmin(v), np.nanmax(v)
    t = np.nan_to_num((v - low) / (high - low) if high > low else np.zeros_like(v))
    return 1 - t if invert else t


def depth_map_to_image(values, source_h: int, source_w: int, target_h: int, target_w: int, invert: bool = False) -> Column:
    def shown(v):
        t = _normalised(np.asarray(v, float).reshape(source_h, source_w), invert)
        return rgba(np.rint(stretch(t[:, :, None] * 255, target_w, target_h)).astype(np.uint8))

    return image(shown, values, size=4 * target_w * target_h)


def points_to_depth_image(points, source_h: int, source_w: int, target_h: int, target_w: int, invert: bool = False) -> Column:
    return depth_map_to_image(F.transform(F.sequence(F.lit(0), F.lit(source_h * source_w - 1)), lambda i: F.get(_c(points), i * 3 + 2)), source_h, source_w, target_h, target_w, invert)


def normal_to_image(normals, source_h: int, source_w: int, target_h: int, target_w: int) -> Column:
    def shown(v):
        n = (np.asarray(v, float).reshape(source_h, source_w, 3) + 1) * 127.5
        return rgba(np.clip(np.rint(stretch(n, target_w, target_h)), 0, 255).astype(np.uint8))

    return image(shown, normals, size=4 * target_w * target_h)


def frames_to_gif(frames, fps: float) -> Column:
    return _mapped("binary", lambda fs: write_gif([unpack(bytes(f)) for f in fs], fps), frames)


def image_draw_bounding_boxes(img, boxes, stroke: tuple = (255, 0, 0), fill: tuple | None = None) -> Column:
    """Boxes are x, y, width and height on end."""

    def drawn(a, b):
        out = rgba(a).copy()
        for x, y, w, h in np.asarray(b, float).reshape(-1, 4).astype(int):
            part = out[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
            if not part.size:
                continue
            if fill is not None:
                part[1:-1, 1:-1, : len(fill)] = fill
            for line in (part[0], part[-1], part[:, 0], part[:, -1]):
                line[:, :3] = stroke
                line[:, 3] = 255
        return out

    return image(drawn, img, boxes)


# Tensors


def clip_mean() -> Column:
    return F.array(*map(F.lit, CLIP_MEAN)).cast("array<float>")


def clip_std() -> Column:
    return F.array(*map(F.lit, CLIP_STD)).cast("array<float>")


def _tensor(a: np.ndarray, mean, std, order: str) -> np.ndarray:
    t = (a / 255.0 - np.array(mean if mean is not None else 0.0)) / np.array(std if std is not None else 1.0)
    return (t.transpose(2, 0, 1) if order == "chw" else t).astype(np.float32).ravel()


def _to_tensor(order: str, prepare):
    def run(img, size: int, mean=None, std=None) -> Column:
        return _mapped("array<float>", lambda a: _tensor(stretch(prepare(a), size, size), mean, std, order), img, size=12 * size * size)

    return run


image_to_tensor_chw = _to_tensor("chw", rgb)
image_to_tensor_hwc = _to_tensor("hwc", rgb)
image_to_tensor_chw_bgr = _to_tensor("chw", lambda a: rgb(a)[:, :, ::-1])
image_to_tensor_chw_gray = _to_tensor("chw", lambda a: luma(a)[:, :, None])


def letterbox(a: np.ndarray, size: int, fill: float) -> np.ndarray:
    k = size / max(a.shape[:2])
    h, w = max(1, round(a.shape[0] * k)), max(1, round(a.shape[1] * k))
    out = np.full((size, size, a.shape[2]), float(fill))
    y, x = (size - h) // 2, (size - w) // 2
    out[y : y + h, x : x + w] = stretch(a, w, h)
    return out


def image_letterbox_tensor_chw(img, size: int, mean=None, std=None, pad_fill: float = 114.0, order: str = "chw") -> Column:
    return _mapped("array<float>", lambda a: _tensor(letterbox(rgb(a), size, pad_fill), mean, std, order), img, size=12 * size * size)


def image_letterbox_tensor_hwc(img, size: int, mean=None, std=None, pad_fill: float = 114.0) -> Column:
    return image_letterbox_tensor_chw(img, size, mean, std, pad_fill, "hwc")


def yolox_preprocess(img, size: int) -> Column:
    """Blue, green, red from 0 to 255, in the top left corner of a grey square."""

    def put(a):
        k = size / max(a.shape[:2])
        h, w = max(1, int(a.shape[0] * k)), max(1, int(a.shape[1] * k))
        out = np.full((size, size, 3), 114.0)
        out[:h, :w] = stretch(rgb(a)[:, :, ::-1], w, h)
        return out.transpose(2, 0, 1).astype(np.float32).ravel()

    return _mapped("array<float>", put, img, size=12 * size * size)


def _of_tensor(order: str, channels: int):
    def run(tensor, height: int, width: int, mean=None, std=None) -> Column:
        def made(v):
            t = np.asarray(v, float)
            t = t.reshape(channels, height, width).transpose(1, 2, 0) if order == "chw" else t.reshape(height, width, channels)
            t = (t * np.array(std if std is not None else 1.0) + np.array(mean if mean is not None else 0.0)) * 255
            return rgb(np.clip(np.rint(t), 0, 255).astype(np.uint8))

        return image(made, tensor)

    return run


tensor_to_image_chw, tensor_to_image_hwc, tensor_to_image_chw_gray = _of_tensor("chw", 3), _of_tensor("hwc", 3), _of_tensor("chw", 1)


# Detections: arrays of (label, score, x1, y1, x2, y2).

FOUND = "array<struct<label:string,score:float,x1:float,y1:float,x2:float,y2:float>>"


def overlap_kept(boxes: np.ndarray, scores: np.ndarray, limit: float) -> list[int]:
    """Places of the boxes that stay, best first: none overlaps a better one by more than ``limit``."""
    kept: list[int] = []
    area = np.maximum(boxes[:, 2] - boxes[:, 0], 0) * np.maximum(boxes[:, 3] - boxes[:, 1], 0)
    for i in np.argsort(-scores, kind="stable").tolist():
        k = np.array(kept, int)
        w = np.minimum(boxes[i, 2], boxes[k, 2]) - np.maximum(boxes[i, 0], boxes[k, 0])
        h = np.minimum(boxes[i, 3], boxes[k, 3]) - np.maximum(boxes[i, 1], boxes[k, 1])
        both = np.maximum(w, 0) * np.maximum(h, 0)
        if not (both > limit * np.maximum(area[i] + area[k] - both, 1e-12)).any():
            kept.append(i)
    return kept


def _listed(labels, which, scores, boxes) -> list[dict]:
    return [{"label": labels[int(c)] if int(c) < len(labels) else str(int(c)), "score": float(s), "x1": float(b[0]), "y1": float(b[1]), "x2": float(b[2]), "y2": float(b[3])} for c, s, b in zip(which, scores, boxes)]


def rtdetr_postprocess(logits, boxes, labels: list[str], img, threshold: float = 0.5) -> Column:
    """The best class of each query; boxes are centre and size as shares of the image."""

    def found(z, b, a):
        p = 1 / (1 + np.exp(-np.asarray(z, float).reshape(-1, len(labels))))
        b = np.asarray(b, float).reshape(-1, 4)
        best, keep = p.argmax(axis=1), p.max(axis=1) >= threshold
        half = b[:, 2:] / 2
        corners = np.concatenate([b[:, :2] - half, b[:, :2] + half], axis=1) * [a.shape[1], a.shape[0], a.shape[1], a.shape[0]]
        return _listed(labels, best[keep], p.max(axis=1)[keep], corners[keep])

    return _mapped(FOUND, found, logits, boxes, img)


def yolox_postprocess(raw, labels: list[str], img, size: int, threshold: float = 0.3, iou: float = 0.45) -> Column:
    """Boxes of the three grids (strides 8, 16 and 32), kept class by class and scaled back."""

    def found(v, a):
        v = np.asarray(v, float).reshape(-1, 5 + len(labels))
        cells = [(x, y, s) for s in (8, 16, 32) for y in range(size // s) for x in range(size // s)]
        g = np.array(cells, float)
        centre, extent = (v[:, :2] + g[:, :2]) * g[:, 2:], np.exp(v[:, 2:4]) * g[:, 2:]
        p = v[:, 4:5] * v[:, 5:]
        which, score = p.argmax(axis=1), p.max(axis=1)
        keep = score >= threshold
        corners = np.concatenate([centre - extent / 2, centre + extent / 2], axis=1)[keep] / (size / max(a.shape[:2]))
        which, score, out = which[keep], score[keep], []
        for c in np.unique(which):
            at = np.flatnonzero(which == c)
            out += at[overlap_kept(corners[at], score[at], iou)].tolist()
        out.sort(key=lambda i: -score[i])
        return _listed(labels, which[out], score[out], corners[out])

    return _mapped(FOUND, found, raw, img)


# Masks of segmentation


def binary_mask_from_logits(logits, threshold: float = 0.0) -> Column:
    return F.transform(_c(logits), lambda x: F.when(x > threshold, 1.0).otherwise(0.0).cast("float"))


def sam_stability_score(logits, threshold: float = 0.0, offset: float = 1.0) -> Column:
    """Places above the raised threshold as a share of those above the lowered one."""
    size = lambda t: F.size(F.filter(_c(logits), lambda x: x > t)).cast("double")
    return F.when(size(threshold - offset) > 0, size(threshold + offset) / size(threshold - offset)).otherwise(0.0)


def sam_preprocess(img, size: int = 1024, mean=(123.675, 116.28, 103.53), std=(58.395, 57.12, 57.375)) -> Column:
    """The longest side is resized; samples are normalised, and the rest of the square is zero."""

    def put(a):
        k = size / max(a.shape[:2])
        h, w = round(a.shape[0] * k), round(a.shape[1] * k)
        out = np.zeros((size, size, 3))
        out[:h, :w] = (stretch(rgb(a), w, h) - np.array(mean)) / np.array(std)
        return out.transpose(2, 0, 1).astype(np.float32).ravel()

    return _mapped("array<float>", put, img, size=12 * size * size)


def mask_nms_planes(masks, scores, height: int, width: int, iou: float) -> Column:
    """Places of the masks that stay, best first, by the overlap of their planes."""

    def kept(m, s):
        planes, out = np.asarray(m, float).reshape(-1, height * width) > 0, []
        for i in np.argsort(-np.asarray(s, float), kind="stable").tolist():
            if all((planes[i] & planes[k]).sum() <= iou * max((planes[i] | planes[k]).sum(), 1) for k in out):
                out.append(i)
        return out

    return _mapped("array<int>", kept, masks, scores)


# Waveforms


def audio(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (frames by channels, from -1 to 1) of a PCM WAV file."""
    import io
    import wave

    with wave.open(io.BytesIO(raw)) as f:
        rate, n, c = f.getframerate(), f.getsampwidth(), f.getnchannels()
        body = f.readframes(f.getnframes())
    if n == 1:
        v = np.frombuffer(body, np.uint8).astype(float) / 128 - 1
    elif n == 3:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
        v = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) / 0x800000 - 1
    else:
        v = np.frombuffer(body, f"<i{n}").astype(float) / (1 << (8 * n - 1))
    return rate, v.reshape(-1, c)


def write_wav(rate: int, mono: np.ndarray) -> bytes:
    body = np.clip(np.rint(mono * 32768), -32768, 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(body)) + body


def audio_decode(x) -> Column:
    """The file itself, once its head has been read."""
    return _mapped("binary", lambda raw: (audio(raw), bytes(raw))[1], x)


def audio_sample_rate(x) -> Column:
    return _mapped("int", lambda raw: audio(raw)[0], x)


def audio_duration(x) -> Column:
    return _mapped("double", lambda raw: (lambda r, v: len(v) / r)(*audio(raw)), x)


def audio_samples(rate: int, x) -> Column:
    """Mono samples at a rate, by straight lines between the given ones."""

    def at(raw):
        own, v = audio(raw)
        v = v.mean(axis=1)
        n = round(len(v) * rate / own)
        return np.interp(np.arange(n) * own / rate, np.arange(len(v)), v).astype(np.float32) if len(v) else v.astype(np.float32)

    return _mapped("array<float>", at, x)


def audio_to_mono(x) -> Column:
    return _mapped("binary", lambda raw: (lambda r, v: write_wav(r, v.mean(axis=1)))(*audio(raw)), x)


def envelope(v: np.ndarray, bins: int) -> np.ndarray:
    cuts = np.linspace(0, len(v), bins + 1).astype(int)
    parts = [v[a : max(b, a + 1)] for a, b in zip(cuts[:-1], cuts[1:])]
    return np.array([(p.min(), p.max()) if len(p) else (0.0, 0.0) for p in parts])


def audio_waveform_envelope(x, bins: int) -> Column:
    """The least and largest sample of each bin, on end."""
    return _mapped("array<float>", lambda raw: envelope(audio(raw)[1].mean(axis=1), bins).astype(np.float32).ravel(), x)


def audio_waveform(x, width: int, height: int, fg: tuple = (255, 255, 255), bg: tuple = (0, 0, 0)) -> Column:
    """One bar a column from the least to the largest sample."""

    def drawn(raw):
        e = envelope(audio(raw)[1].mean(axis=1), width)
        y = np.arange(height)[:, None]
        top, low = (1 - e[:, 1]) / 2 * (height - 1), (1 - e[:, 0]) / 2 * (height - 1)
        on = (y >= np.floor(top)) & (y <= np.ceil(low))
        return rgba(np.where(on[:, :, None], np.array(fg, np.uint8), np.array(bg, np.uint8)))

    return _mapped("binary", lambda raw: pack(drawn(raw)), x, size=4 * width * height)


FRAMES = 3000


def log_mel(v: np.ndarray, n_mels: int, rate: int = 16_000, size: int = 400, hop: int = 160, frames: int = FRAMES) -> np.ndarray:
    """A log-mel spectrogram of thirty seconds, padded or cut, on Slaney's scale."""
    v = np.pad(v[: frames * hop], (0, max(0, frames * hop - len(v))))
    v = np.pad(v, size // 2, mode="reflect")
    heard = np.flatnonzero(v)  # frames past the last sound hold no power
    n = min(frames, heard[-1] // hop + 1) if len(heard) else 0
    at = np.arange(n)[:, None] * hop + np.arange(size)
    power = np.abs(np.fft.rfft(v[at] * np.hanning(size + 1)[:-1], axis=1)) ** 2
    out = np.full((n_mels, frames), -10.0)
    out[:, :n] = np.log10(np.maximum(mel_filters(n_mels, rate, size) @ power.T, 1e-10))
    return ((np.maximum(out, out.max() - 8) + 4) / 4).astype(np.float32)


@lru_cache
def mel_filters(n_mels: int, rate: int, size: int) -> np.ndarray:
    hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    top = 15 + np.log(rate / 2 / 1000) * 27 / np.log(6.4)
    f, bins = hz(np.linspace(0, top, n_mels + 2)), np.fft.rfftfreq(size, 1 / rate)
    up, down = (bins - f[:-2, None]) / (f[1:-1] - f[:-2])[:, None], (f[2:, None] - bins) / (f[2:] - f[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (f[2:] - f[:-2]))[:, None]


def audio_to_log_mel(samples, n_mels: int) -> Column:
    return _mapped("array<float>", lambda v: log_mel(np.asarray(v, float), n_mels).ravel(), samples, size=4 * n_mels * FRAMES)
