"""Image and array analytics on pixel grids, arrays of numbers in row-major order: width and height are arguments.

Everything is array expressions, so a grid stays in its row and nothing is shuffled, but for the spectrum, which is an Arrow
function. Sobel mirrors the edge without repeating it; convolutions pad with zeros.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row; written out, each use inside a lambda would compute it anew."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded with its sign: what is below zero and rounds to zero is minus zero, as in IEEE arithmetic."""
    r = F.round(c, places)
    return F.when(r == 0, c * 0.0).otherwise(r)


def _at(a: Column, y, x, w: int, h: int, edge: str) -> Column:
    if edge == "mirror":
        fold = lambda v, n: F.when(v < 0, -v).when(v >= n, 2 * (n - 1) - v).otherwise(v)
        return F.element_at(a, (fold(y, h) * w + fold(x, w) + 1).cast("int"))
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    return F.when(inside, F.try_element_at(a, (F.greatest(y, F.lit(0)) * w + F.greatest(x, F.lit(0)) + 1).cast("int"))).otherwise(F.lit(0.0))


def convolve(a: Column, kernel: list[list[float]], w: int, h: int, edge: str = "zero", stride: int = 1, centre: tuple[int, int] | None = None) -> Column:
    """Cross-correlation with a small kernel, one value per stride-th pixel."""
    cy, cx = centre if centre is not None else (len(kernel) // 2, len(kernel[0]) // 2)
    wo, ho = -(-w // stride), -(-h // stride)

    def pixel(g):
        def one(k):
            y, x = F.floor(k / wo) * stride, (k % wo) * stride
            terms = [_at(g, y + i - cy, x + j - cx, w, h, edge) * float(v) for i, row in enumerate(kernel) for j, v in enumerate(row) if v]
            return sum(terms[1:], terms[0])

        return F.transform(F.sequence(F.lit(0), F.lit(wo * ho - 1)), one)

    return let(a, pixel)


SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
# Fixed value: the high-pass kernel of the noise residual.
HIGH_PASS = [[-1, 2, -2, 2, -1], [2, -6, 8, -6, 2], [-2, 8, -12, 8, -2], [2, -6, 8, -6, 2], [-1, 2, -2, 2, -1]]


def sobel(a: Column, w: int, h: int) -> Column:
    """Gradient magnitude over its maximum."""
    gy, gx = convolve(a, SOBEL_Y, w, h, "mirror"), convolve(a, SOBEL_X, w, h, "mirror")
    return over_max(F.zip_with(gy, gx, lambda y, x: F.sqrt(y * y + x * x)))


def over_max(a: Column) -> Column:
    return let(a, lambda g: let(F.array_max(g) + 1e-7, lambda m: F.transform(g, lambda v: v / m)))


def gradient_covariance(a: Column, w: int, h: int) -> Column:
    """struct(xx, xy, yy): uncentred second moments of the gradients. The grid is luma already."""
    gy, gx = convolve(a, SOBEL_Y, w, h, "mirror"), convolve(a, SOBEL_X, w, h, "mirror")
    mean = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v) / (w * h)
    return F.struct(mean(gx, gx).alias("xx"), mean(gx, gy).alias("xy"), mean(gy, gy).alias("yy"))


def grey(r: Column, g: Column, b: Column) -> Column:
    """A grid of the brightness of three channels' grids."""
    third = F.zip_with(r, g, lambda x, y: 0.2989 * x + 0.587 * y)
    return F.zip_with(third, b, lambda x, y: x + 0.114 * y)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


HAAR = {"ll": [[1, 1], [1, 1]], "lh": [[1, 1], [-1, -1]], "hl": [[1, -1], [1, -1]], "hh": [[1, -1], [-1, 1]]}


def haar(a: Column, w: int, h: int, scale: float = 2.0) -> Column:
    """struct(ll, lh, hl, hh) of 2 x 2 blocks, each coefficient over `scale`."""
    band = lambda k: F.transform(convolve(a, k, w, h, stride=2, centre=(0, 0)), lambda v: v / scale)
    return F.struct(*[band(k).alias(n) for n, k in HAAR.items()])


def min_max(a: Column) -> Column:
    return let(a, lambda g: let(F.array_min(g), lambda low: let(F.array_max(g) - low + 1e-7, lambda span: F.transform(g, lambda v: (v - low) / span))))


def _jointly(bands: dict[str, Column], low: Column, span) -> Column:
    """struct of bands, each value less `low` and over `span`; low and span come from all bands together."""
    return F.struct(*[F.transform(v, lambda x: (x - low) / span).alias(n) for n, v in bands.items()])


DETAIL = ("lh", "hl", "hh")


def haar_detail(a: Column, w: int, h: int, size: tuple[int, int] | None = None) -> Column:
    """struct(lh, hl, hh), each resized to `size` (width, height) where one is given, scaled to the least and greatest value of all three."""

    def scaled(b):
        bands = {n: b[n] for n in DETAIL}
        both = F.concat(*bands.values())
        return let(F.struct(F.array_min(both).alias("low"), (F.array_max(both) - F.array_min(both) + 1e-7).alias("span")), lambda m: _jointly(bands, m["low"], m["span"]))

    return let(_resized(haar(a, w, h), w, h, size), scaled)


def haar_layer(a: Column, w: int, h: int, size: tuple[int, int] | None = None) -> Column:
    """The variant of a model's input layer: absolute values over 4, over the greatest of all three bands, then resized."""

    def scaled(b):
        bands = {n: F.transform(b[n], F.abs) for n in DETAIL}
        return let(F.array_max(F.concat(*bands.values())) + 1e-7, lambda m: _jointly(bands, F.lit(0.0), m))

    return _resized(let(haar(a, w, h, 4.0), scaled), w, h, size)


def _resized(bands: Column, w: int, h: int, size: tuple[int, int] | None) -> Column:
    """The three detail bands of a w x h grid, half its size, at `size`."""
    if size is None:
        return bands
    return let(bands, lambda b: F.struct(*[resize(b[n], -(-w // 2), -(-h // 2), *size).alias(n) for n in DETAIL]))


Taps = list[list[tuple[int, float]]]


def bilinear(n: int, m: int, antialias: bool = False) -> Taps:
    """For each of m places the weights of n values. Pixel centres lie at half steps, values beyond the edge repeat it;
    antialias widens the triangle when values are made fewer."""
    scale, out = n / m, []
    for j in range(m):
        at = (j + 0.5) * scale - 0.5
        if antialias and scale > 1:
            near = [(i, 1 - abs(i - at) / scale) for i in range(math.floor(at - scale), math.ceil(at + scale) + 1) if 0 <= i < n and abs(i - at) < scale]
            total = sum(v for _, v in near)
            out.append([(i, v / total) for i, v in near])
        else:
            low, part = math.floor(at), at - math.floor(at)
            out.append([(max(low, 0), 1 - part), (min(low + 1, n - 1), part)] if part else [(low, 1.0)])
    return out


def area(n: int, m: int) -> Taps:
    """For each of m places the share that each of n values has in it."""
    scale, out = n / m, []
    for j in range(m):
        a, b = j * scale, (j + 1) * scale
        out.append([(i, v / scale) for i in range(math.floor(a), min(n, math.ceil(b))) if (v := min(b, i + 1) - max(a, i)) > 1e-12])
    return out


def resample(a: Column, w: int, rows: Taps, cols: Taps) -> Column:
    """A grid of width w made len(cols) wide and len(rows) high: weighted sums down the columns, then along the rows."""
    table = lambda taps: F.expr("array(" + ",".join("array(" + ",".join(f"named_struct('i', {i}, 'w', {float(v)!r}D)" for i, v in one) + ")" for one in taps) + ")")
    wide = len(cols)

    def summed(g, taps, which, at):
        return F.aggregate(F.element_at(taps, which.cast("int") + 1), F.lit(0.0), lambda s, x: s + x["w"] * F.element_at(g, (at(x["i"])).cast("int") + 1))

    def down(g):
        return F.transform(F.sequence(F.lit(0), F.lit(w * len(rows) - 1)), lambda k: summed(g, table(rows), F.floor(k / w), lambda i: i * w + k % w))

    def along(g):
        return F.transform(F.sequence(F.lit(0), F.lit(wide * len(rows) - 1)), lambda k: summed(g, table(cols), k % wide, lambda i: F.floor(k / wide) * w + i))

    return let(let(a, down), along)


def resize(a: Column, w: int, h: int, to_w: int, to_h: int, antialias: bool = False) -> Column:
    """Bilinear."""
    return resample(a, w, bilinear(h, to_h, antialias), bilinear(w, to_w, antialias))


def noise_residual(a: Column, w: int, h: int) -> Column:
    return convolve(a, HIGH_PASS, w, h)


def quantize(a: Column, levels: int = 8, most: float = 256.0) -> Column:
    return F.transform(a, lambda v: F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.floor(v / (most / levels)).cast("int"))))


def co_occurrence(a: Column, w: int, h: int, levels: int = 8) -> Column:
    """levels * levels counts, row-major, of horizontally neighbouring levels, both ways. a: levels 0 .. levels - 1."""
    cells = F.sequence(F.lit(0), F.lit(w * h - 1))

    def pairs(g):
        one = F.transform(F.filter(cells, lambda k: k % w < w - 1), lambda k: F.element_at(g, k + 1) * levels + F.element_at(g, k + 2))
        return let(one, lambda p: F.concat(p, F.transform(p, lambda v: (v % levels) * levels + F.floor(v / levels).cast("int"))))

    count = lambda both: F.transform(F.sequence(F.lit(0), F.lit(levels * levels - 1)), lambda c: F.size(F.filter(both, lambda p: p == c)))
    return let(let(a, pairs), count)


def flip(a: Column, w: int, h: int, horizontal: bool = True) -> Column:
    return let(a, lambda g: F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda k: F.element_at(g, ((F.floor(k / w) * w + (w - 1 - k % w)) if horizontal else ((h - 1 - F.floor(k / w)) * w + k % w)).cast("int") + 1)))


def rot90(a: Column, w: int, h: int) -> Column:
    """Counter-clockwise; the result is h wide and w high."""
    return let(a, lambda g: F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda k: F.element_at(g, ((k % h) * w + (w - 1 - F.floor(k / h))).cast("int") + 1)))


def clip(a: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.transform(a, lambda v: F.greatest(F.lit(low), F.least(F.lit(high), v)))


def blur(a: Column, w: int, h: int) -> Column:
    return convolve(a, [[1 / 9] * 3] * 3, w, h)


def down_up(a: Column, w: int, h: int, to: tuple[int, int] = (112, 112)) -> Column:
    """To another size (width, height) by area, and back bilinearly."""
    small = resample(a, w, area(h, to[1]), area(w, to[0]))
    return resize(small, *to, w, h, antialias=True)


def add_noise(a: Column, key: Column, sigma: float = 0.05) -> Column:
    """Add normal noise that follows from the row's key, clipped to [0, 1]: the sum of twelve hashed uniforms less six."""
    unit = lambda k, i: F.pmod(F.xxhash64(key, k, F.lit(i)), F.lit(1_000_003)) / 1_000_003.0
    return clip(F.transform(a, lambda v, k: v + sigma * (sum((unit(k, i) for i in range(1, 12)), unit(k, 0)) - 6)))


def corrupt(a: Column, key: Column, kind: str, w: int, h: int, to: tuple[int, int] = (112, 112)) -> Column:
    """One channel under blur3, resize112 (to the size `to` and back) or noise05, also called blur, resize_down and noise; the JPEG ones need a codec and are not built."""
    if kind in ("blur3", "blur"):
        return blur(a, w, h)
    if kind in ("resize112", "resize_down"):
        return down_up(a, w, h, to)
    if kind in ("noise05", "noise"):
        return add_noise(a, key)
    raise ValueError(f"no corruption {kind}")


MODES = ("rgb", "sobel", "rgb+sobel", "wavelet", "rgb+wavelet")


def dispatch(r: Column, g: Column, b: Column, mode: str, w: int, h: int) -> Column:
    """struct(r, g, b), the three channels of an image under a mode: rgb (as they are), sobel (the edges of the grey image three
    times), wavelet (its three detail bands at full size), or the mean of rgb and one of these, clipped to [0, 1]."""
    mode = mode.strip().lower()
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    image = F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    if mode == "rgb":
        return image
    if mode.endswith("sobel"):
        made = let(sobel(grey(r, g, b), w, h), lambda e: F.struct(e.alias("r"), e.alias("g"), e.alias("b")))
    else:
        made = let(haar_detail(grey(r, g, b), w, h, (w, h)), lambda d: F.struct(*[d[n].alias(c) for n, c in zip(DETAIL, "rgb")]))
    if not mode.startswith("rgb+"):
        return made
    mean = lambda p, q: clip(F.zip_with(p, q, lambda s, t: (s + t) / 2))
    return let(made, lambda m: F.struct(*[mean(x, m[c]).alias(c) for x, c in zip((r, g, b), "rgb")]))


def spectrum_features(a: Column, w: int, h: int, rows_only: bool = False) -> Column:
    """struct(mean, variance, skewness, high) of the log spectrum; high is the mean above the mean. rows_only transforms
    each row by itself, as an older tool did by its tensor's shape."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("struct<mean:double,variance:double,skewness:double,high:double>")
    def run(grids):
        out = []
        for g in grids:
            x = np.asarray(g, float).reshape(h, w)
            s = np.log(np.abs(np.fft.fft(x, axis=1) if rows_only else np.fft.fft2(x)) + 1e-8)
            m, v = s.mean(), s.var()
            above = s[s > m]
            out.append((m, v, ((s - m) ** 3).mean() / (v**1.5 + 1e-8), above.mean() if len(above) else m))
        return pd.DataFrame(out, columns=["mean", "variance", "skewness", "high"])

    return run(a)
