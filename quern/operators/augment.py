"""Augmentation of colour grids, structs (r, g, b) of arrays of numbers in [0, 1] in row-major order, by domain.

Every choice follows from the row's key, the seed and the epoch, and noise from the pixel's number too, so results do not depend on
partitions or on other rows. A crop, flips and turns are one resampling: each pixel is read from its place in the given grid, so no
larger grid is made. Values are clipped to [0, 1] at the end. Re-encoding as JPEG, which some domains also have, needs a codec and is left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import draws
from .grid import blur, clip, let

#: What each domain does. Chances of a flip (left to right, upside down), of a turn by quarters, of blur and of noise; largest
#: change of brightness and of hue; range of the factors of contrast and of saturation.
GENERAL = {"flip": 0.5, "upside": 0.0, "turn": 0.0, "brightness": 0.1, "contrast": (0.9, 1.1), "saturation": (0.9, 1.1), "hue": 0.02, "blur": 0.25, "noise": 0.25}
DOCUMENT = {"flip": 0.0, "upside": 0.0, "turn": 0.0, "brightness": 0.05, "contrast": (0.95, 1.1), "saturation": (1.0, 1.0), "hue": 0.0, "blur": 0.0, "noise": 0.1}
SATELLITE = {"flip": 0.5, "upside": 0.5, "turn": 1.0, "brightness": 0.06, "contrast": (0.95, 1.08), "saturation": (1.0, 1.0), "hue": 0.0, "blur": 0.15, "noise": 0.1}
FACE = {"flip": 0.5, "upside": 0.0, "turn": 0.0, "brightness": 0.08, "contrast": (0.92, 1.08), "saturation": (0.92, 1.08), "hue": 0.015, "blur": 0.15, "noise": 0.15}
#: Domains by name; any other is general.
DOMAINS = {"doc": DOCUMENT, "satellite": SATELLITE, "ff++": FACE, "chameleon": FACE}
#: The range that an image is scaled by before it is cropped to its size again, and the deviation of noise.
SCALE, SIGMA = (0.9, 1.1), 0.02

CHANNELS = ("r", "g", "b")


def choices(key: Column, domain: Column, w: int, h: int, seed: int, epoch: int) -> Column:
    """struct of a row's choices: size after scaling (tall, wide) and the crop's corner (top, left), flip, upside, turns, brightness,
    contrast, saturation, hue, blur, noise, and the row's key for pixels. Grids that are not square turn by halves only."""
    row = draws.row_key(key, seed, epoch)
    name = F.lower(F.trim(domain))

    def given(pick):
        out = F.lit(float(pick(GENERAL)))
        for d, settings in DOMAINS.items():
            out = F.when(name == d, float(pick(settings))).otherwise(out)
        return out

    def chosen(r):
        chance = lambda what: draws.uniform(r, what) < given(lambda s: s[what])
        factor = lambda what: draws.between(r, what, given(lambda s: s[what][0]), given(lambda s: s[what][1]))
        scale = draws.between(r, "scale", *map(F.lit, SCALE))
        tall, wide = (F.greatest(F.lit(n), F.floor(F.lit(n) * scale).cast("int")) for n in (h, w))
        corner = lambda what, size, n: F.floor(draws.uniform(r, what) * (size - n + 1)).cast("int")
        turns = F.floor(draws.uniform(r, "turns") * 4).cast("int")
        if w != h:
            turns = turns - turns % 2
        shift = lambda what: draws.between(r, what, -given(lambda s: s[what]), given(lambda s: s[what]))
        return F.struct(
            tall.alias("tall"), wide.alias("wide"), corner("top", tall, h).alias("top"), corner("left", wide, w).alias("left"), chance("flip").alias("flip"), chance("upside").alias("upside"),
            F.when(chance("turn"), turns).otherwise(F.lit(0)).alias("turns"), shift("brightness").alias("brightness"), factor("contrast").alias("contrast"), factor("saturation").alias("saturation"),
            shift("hue").alias("hue"), chance("blur").alias("blur"), chance("noise").alias("noise"), r["one"].alias("one"), r["two"].alias("two"),
        )

    return let(row, chosen)


def moved(image: Column, c: Column, w: int, h: int) -> Column:
    """The three channels scaled bilinearly, cropped, flipped and turned as chosen, each pixel from its place."""

    def source(k):
        """Where pixel k comes from, as (y, x) in the scaled and cropped grid: turns undone, then flips."""
        y, x = F.floor(k / w), k % w
        if w == h:  # counter-clockwise: what is at (y, x) after a quarter was at (x, w - 1 - y)
            y, x = (
                F.when(c["turns"] == 1, x).when(c["turns"] == 2, h - 1 - y).when(c["turns"] == 3, w - 1 - x).otherwise(y),
                F.when(c["turns"] == 1, w - 1 - y).when(c["turns"] == 2, w - 1 - x).when(c["turns"] == 3, y).otherwise(x),
            )
        else:
            y, x = F.when(c["turns"] == 2, h - 1 - y).otherwise(y), F.when(c["turns"] == 2, w - 1 - x).otherwise(x)
        y = F.when(c["upside"], h - 1 - y).otherwise(y) + c["top"]
        x = F.when(c["flip"], w - 1 - x).otherwise(x) + c["left"]
        at = lambda v, n, size: F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), (v + 0.5) * F.lit(float(n)) / size - 0.5))
        return F.struct(at(y, h, c["tall"]).alias("y"), at(x, w, c["wide"]).alias("x"))

    def read(g):
        def one(p):
            y, x = F.floor(p["y"]).cast("int"), F.floor(p["x"]).cast("int")
            dy, dx = p["y"] - y, p["x"] - x
            down, right = F.least(y + 1, F.lit(h - 1)), F.least(x + 1, F.lit(w - 1))
            v = lambda i, j: F.element_at(g, (i * w + j + 1).cast("int"))
            return (v(y, x) * (1 - dx) + v(y, right) * dx) * (1 - dy) + (v(down, x) * (1 - dx) + v(down, right) * dx) * dy

        return one

    places = F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), source)
    return let(places, lambda p: F.struct(*[F.transform(p, read(image[k])).alias(k) for k in CHANNELS]))


def contrasted(a: Column, factor: Column) -> Column:
    """Each value's distance from the channel's mean, times a factor."""
    mean = F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return let(mean, lambda m: F.transform(a, lambda v: (v - m) * factor + m))


def coloured(image: Column, saturation: Column, hue: Column) -> Column:
    """Saturation times a factor (to 1 at the most) and hue moved by a share of the circle, brightness of the strongest channel kept."""

    def pixel(p):
        top, low = F.greatest(p["r"], p["g"], p["b"]), F.least(p["r"], p["g"], p["b"])

        def turned(s):
            # the place on the circle in sixths, then each channel's share of the span by its distance from its own place
            six = F.when(s["top"] == p["r"], (p["g"] - p["b"]) / s["span"]).when(s["top"] == p["g"], 2 + (p["b"] - p["r"]) / s["span"]).otherwise(4 + (p["r"] - p["g"]) / s["span"]) + hue * 6
            span = s["top"] * F.least(F.lit(1.0), s["span"] / s["top"] * saturation)

            def channel(k, at):
                return let(F.pmod(F.lit(float(k)) + at, F.lit(6.0)), lambda d: s["top"] - span * F.greatest(F.lit(0.0), F.least(d, 4 - d, F.lit(1.0))))

            full = let(six, lambda at: F.struct(channel(5, at).alias("r"), channel(3, at).alias("g"), channel(1, at).alias("b")))
            return F.when((s["span"] <= 0) | (s["top"] <= 0), F.struct(*[p[c].alias(c) for c in CHANNELS])).otherwise(full)

        return let(F.struct(top.alias("top"), (top - low).alias("span")), turned)

    pixels = F.transform(F.arrays_zip(*[image[c].alias(c) for c in CHANNELS]), pixel)
    return let(pixels, lambda ps: F.struct(*[F.transform(ps, lambda p: p[c]).alias(c) for c in CHANNELS]))  # noqa: B023


def augment(image: Column, key: Column, domain: Column, w: int, h: int, seed: int, epoch: int) -> Column:
    """struct(r, g, b) of an image's grids, augmented as its domain asks. A null image is null, a null domain is general."""

    def jittered(m, c):
        bright = F.struct(*[contrasted(F.transform(m[k], lambda v: v + c["brightness"]), c["contrast"]).alias(k) for k in CHANNELS])
        return F.when((c["saturation"] == 1) & (c["hue"] == 0), bright).otherwise(let(bright, lambda b: coloured(b, c["saturation"], c["hue"])))

    def finished(j, c):
        out = []
        for number, k in enumerate(CHANNELS):
            soft = F.when(c["blur"], blur(j[k], w, h)).otherwise(j[k])
            noisy = F.transform(soft, lambda v, i: v + SIGMA * draws.normal(c, "noise", i * 3 + number))  # noqa: B023
            out.append(clip(F.when(c["noise"], noisy).otherwise(soft)).alias(k))
        return F.struct(*out)

    def whole(c):
        return let(moved(image, c, w, h), lambda m: let(jittered(m, c), lambda j: finished(j, c)))

    return F.when(image.isNotNull(), let(choices(key, domain, w, h, seed, epoch), whole))
