"""Millimetre points to brain cells and back, sphere binning, affines.

A template is a mapping of Columns, so it can be literals (one atlas) or columns
of a joined template table (one template per subject).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodygrid import frames as fr
from bodygrid.functions import address as ad
from bodygrid.functions.once import once

# The ICBM152 2009c brain template, millimetres.
ICBM152 = {
    "id": "icbm152-2009c-asym",
    "ac": [0.0, 0.0, 0.0],
    "left": [-1.0, 0.0, 0.0],
    "anterior": [0.0, 1.0, 0.0],
    "superior": [0.0, 0.0, 1.0],
    "extents": {"left": 72.5, "right": 72.5, "anterior": 73.5, "posterior": 108.5, "superior": 82.5, "inferior": 72.5},
    "max_useful_digits": 6,
}
NEAR_ONE = 1 - 1e-12


def literal_template(t: dict) -> dict:
    vec = lambda v: [F.lit(float(x)) for x in v]
    out = {k: vec(t[k]) for k in ("ac", "left", "anterior", "superior")}
    out |= {f"ext_{k}": F.lit(float(v)) for k, v in t["extents"].items()}
    return out | {"id": F.lit(t["id"]), "max_useful_digits": F.lit(t["max_useful_digits"])}


def template_columns(prefix: str = "") -> dict:
    """A template held in columns ``ac``, ``left`` ... (arrays) and ``extents`` (struct)."""
    vec = lambda n: [F.col(prefix + n)[i] for i in range(3)]
    out = {k: vec(k) for k in ("ac", "left", "anterior", "superior")}
    names = ("left", "right", "anterior", "posterior", "superior", "inferior")
    out |= {f"ext_{n}": F.col(f"{prefix}extents")[n] for n in names}
    return out | {"id": F.col(prefix + "id"), "max_useful_digits": F.col(prefix + "max_useful_digits")}


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _split(mm: Column, neg: Column, pos: Column) -> Column:
    return F.when(mm < 0, F.when(neg > 0, 0.5 + mm / (2 * neg)).otherwise(0.0)).otherwise(
        F.when(pos > 0, 0.5 + mm / (2 * pos)).otherwise(1.0)
    )


def _unsplit(frac: Column, neg: Column, pos: Column) -> Column:
    return F.when(frac < 0.5, (frac - 0.5) * 2 * neg).otherwise((frac - 0.5) * 2 * pos)


def _spread(v: Column, step: int) -> Column:
    """Put each bit of a 12-bit number ``step`` places apart."""
    # The usual shifts and masks of bit interleaving.
    masks = {
        3: [(16, 0xFF0000FF), (8, 0x00F00F00F00F), (4, 0x0C30C30C30C3), (2, 0x249249249249)],
        2: [(8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)],
    }[step]
    out = v
    for s, m in masks:
        out = out.bitwiseOR(F.call_function("shiftleft", out, F.lit(s))).bitwiseAND(F.lit(m).cast("long"))
    return out


def _compact(v: Column, step: int) -> Column:
    # The same masks, the other way.
    masks = {
        3: [(2, 0x0C30C30C30C3), (4, 0x00F00F00F00F), (8, 0x0000FF0000FF), (16, 0xFFF)],
        2: [(1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0xFFFF)],
    }[step]
    out = v.bitwiseAND(F.lit({3: 0x249249249249, 2: 0x55555555}[step]).cast("long"))
    for s, m in masks:
        out = out.bitwiseOR(F.call_function("shiftright", out, F.lit(s))).bitwiseAND(F.lit(m).cast("long"))
    return out


def encode_brain(df: DataFrame, x: str, y: str, z: str, tpl: dict, digits: int | Column) -> DataFrame:
    """Add ``cell_key``, ``clamped``, ``clamp_note`` and ``error_code``.

    A NaN point is refused (``nan_coordinate``), never clamped, and so is a digit count of
    a column that the frame does not have (``bad_precision``).
    """
    if isinstance(digits, int) and not 0 <= digits <= fr.MAX_DIGITS["BV"]:
        raise ValueError(f"digit count out of range: {digits}")
    p = [F.col(x).cast("double"), F.col(y).cast("double"), F.col(z).cast("double")]
    bad = F.isnan(p[0]) | F.isnan(p[1]) | F.isnan(p[2]) | p[0].isNull() | p[1].isNull() | p[2].isNull()
    k = F.lit(digits) if isinstance(digits, int) else digits
    deep = ~F.coalesce(k.between(0, fr.MAX_DIGITS["BV"]), F.lit(False))
    rel = [p[i] - tpl["ac"][i] for i in range(3)]
    d = once(
        df,
        {
            "_lat": _dot(rel, tpl["left"]),
            "_ant": _dot(rel, tpl["anterior"]),
            "_sup": _dot(rel, tpl["superior"]),
            "error_code": F.when(bad, "nan_coordinate").when(deep, "bad_precision"),
        },
    )
    lat = F.col("_lat")
    extent = F.when(lat >= 0, tpl["ext_left"]).otherwise(tpl["ext_right"])
    d = once(
        d,
        {
            "_a": F.when(extent > 0, F.abs(lat) / extent).otherwise(0.0),
            "_b": _split(F.col("_ant"), tpl["ext_posterior"], tpl["ext_anterior"]),
            "_c": _split(F.col("_sup"), tpl["ext_inferior"], tpl["ext_superior"]),
        },
    )
    outside = lambda c: (F.col(c) < 0) | (F.col(c) >= 1)
    note = lambda c, n: F.when(outside(c), F.lit(f"{n} fell outside the template bounding box"))
    unit = lambda c: F.floor(F.least(F.lit(NEAR_ONE), F.greatest(F.lit(0.0), F.col(c))) * 4096)
    hemi = F.when(lat >= 0, F.lit(fr.BV_START)).otherwise(F.lit(fr.BV_START + fr.OCT12))
    left = lambda v, n: F.call_function("shiftleft", v, F.lit(n))
    bits = {"_ai": unit("_a"), "_bi": unit("_b"), "_ci": unit("_c")}
    d = once(d, bits)
    d = once(d, {c: _spread(F.col(c), 3) for c in bits})
    morton = left(F.col("_ai"), 2).bitwiseOR(left(F.col("_bi"), 1)).bitwiseOR(F.col("_ci"))
    ok = F.col("error_code").isNull()
    d = once(
        d,
        {
            "_lo": F.when(ok, hemi + morton),
            "clamped": F.when(ok, outside("_a") | outside("_b") | outside("_c")),
            "clamp_note": F.when(
                ok,
                F.concat_ws(
                    "; ",
                    note("_a", "lateral fraction"),
                    note("_b", "anterior-posterior fraction"),
                    note("_c", "superior-inferior fraction"),
                ),
            ),
        },
    )
    d = d.withColumn("cell_key", F.when(ok, ad.key_at(F.col("_lo"), k)))
    return d.drop("_lat", "_ant", "_sup", "_a", "_b", "_c", "_ai", "_bi", "_ci", "_lo")


def locate_brain(df: DataFrame, key: str, tpl: dict) -> DataFrame:
    """Centre, extent along left/anterior/superior, and the over-precision flag of BV cells."""
    lo, rung = ad.key_lo(F.col(key)), ad.key_rung(F.col(key))
    off = lo - F.lit(fr.BV_START)
    d = once(
        df,
        {
            "_hemi": F.when(off < fr.OCT12, 1).otherwise(-1),
            "_m": off % F.lit(fr.OCT12),
            "_n": F.call_function("shiftleft", F.lit(1).cast("long"), rung).cast("double"),
            "_r": rung,
        },
    )
    right = lambda v, n: F.call_function("shiftright", v, F.lit(n) if isinstance(n, int) else n)
    axis = lambda s: right(_compact(right(F.col("_m"), s), 3), 12 - F.col("_r")).cast("double")
    d = once(d, {"_a": axis(2), "_b": axis(1), "_c": axis(0)})
    n = F.col("_n")
    lat_ext = F.when(F.col("_hemi") == 1, tpl["ext_left"]).otherwise(tpl["ext_right"])
    by = lambda f: _unsplit(f, tpl["ext_posterior"], tpl["ext_anterior"])
    cz = lambda f: _unsplit(f, tpl["ext_inferior"], tpl["ext_superior"])
    mid = lambda c: (F.col(c) + 0.5) / n
    d = once(
        d,
        {
            "_lat": lat_ext * mid("_a") * F.col("_hemi"),
            "_y": by(mid("_b")),
            "_z": cz(mid("_c")),
            "extent_lateral": lat_ext / n,
            "extent_ap": F.abs(by((F.col("_b") + 1) / n) - by(F.col("_b") / n)),
            "extent_si": F.abs(cz((F.col("_c") + 1) / n) - cz(F.col("_c") / n)),
        },
    )
    mm = lambda i: (
        tpl["ac"][i] + tpl["left"][i] * F.col("_lat") + tpl["anterior"][i] * F.col("_y") + tpl["superior"][i] * F.col("_z")
    )
    d = d.select(
        "*",
        mm(0).alias("x_mm"),
        mm(1).alias("y_mm"),
        mm(2).alias("z_mm"),
        (F.col("_r") > tpl["max_useful_digits"]).alias("over_precise"),
    )
    return d.drop("_hemi", "_m", "_n", "_r", "_a", "_b", "_c", "_lat", "_y", "_z")


def recommended_digits(df: DataFrame, residual: Column, tpl: dict) -> DataFrame:
    """Deepest digit count each BV cell supports for a residual, and which ceiling binds.

    Extents halve with every digit after the first, so the answer is the first failing
    digit of the cell's own path, padded with zeros. Row-local.
    """
    off = ad.key_lo(F.col("cell_key")) - F.lit(fr.BV_START)
    first = F.call_function("shiftright", off % F.lit(fr.OCT12), F.lit(33))
    bit = lambda n: first.bitwiseAND(F.lit(n).cast("long")) != 0
    lat = F.when(off < fr.OCT12, tpl["ext_left"]).otherwise(tpl["ext_right"])
    ap = 2 * F.when(bit(2), tpl["ext_anterior"]).otherwise(tpl["ext_posterior"])
    si = 2 * F.when(bit(1), tpl["ext_superior"]).otherwise(tpl["ext_inferior"])
    whole = F.least(lat, tpl["ext_anterior"] + tpl["ext_posterior"], tpl["ext_superior"] + tpl["ext_inferior"])
    d = once(df, {"_whole": whole, "_halved": F.least(lat, ap, si), "_res": residual})
    over = lambda n: F.lit(n) > tpl["max_useful_digits"]
    short = lambda n: (F.col("_halved") / (1 << n) if n else F.col("_whole")) < F.col("_res")
    fails = F.coalesce(*[F.when(over(n) | short(n), F.lit(n)) for n in range(fr.MAX_DIGITS["BV"] + 1)])
    d = once(d, {"_f": fails})
    why = F.when(F.col("_f") > tpl["max_useful_digits"], "template").when(F.col("_f") > 0, "residual").otherwise("frame")
    return d.select(
        *df.columns,
        F.coalesce(F.greatest(F.col("_f") - 1, F.lit(0)), F.lit(fr.MAX_DIGITS["BV"])).alias("digits"),
        why.alias("limited_by"),
    )


# ---- sphere -------------------------------------------------------------------


def turn_to_clock(t: Column) -> Column:
    x = F.pmod(t, F.lit(1.0))
    s = (F.floor(x * 12 + 0.5) % 12).cast("int")
    return F.when(s == 0, 12).otherwise(s)


def clock_to_turns(clock: Column) -> tuple[Column, Column]:
    c = (clock % 12) / 12
    return c - 1 / 24, c + 1 / 24


def to_vector(theta: Column, phi: Column) -> list[Column]:
    return [F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta)]


def from_vector(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    r = F.sqrt(x * x + y * y + z * z)
    r = F.when(r == 0, 1.0).otherwise(r)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / r))), F.atan2(y, x)


def sphere_pixel(df: DataFrame, theta: str, phi: str, order: int, out: str = "pix") -> DataFrame:
    """Direction to equal-area nested pixel."""
    nside = 1 << order
    d = once(df, {"_z": F.cos(F.col(theta)), "_tt": F.pmod(F.col(phi), F.lit(2 * math.pi)) / (math.pi / 2)})
    z, tt = F.col("_z"), F.col("_tt")
    cap = F.abs(z) > 2 / 3
    ntt = F.least(F.lit(3).cast("long"), F.floor(tt))
    tmp = nside * F.sqrt(3 * (1 - F.abs(z)))
    top = F.lit(nside - 1).cast("long")
    jp = F.when(cap, F.least(top, F.floor((tt - ntt) * tmp))).otherwise(F.floor(nside * (0.5 + tt) - nside * z * 0.75))
    jm = F.when(cap, F.least(top, F.floor((1 - (tt - ntt)) * tmp))).otherwise(F.floor(nside * (0.5 + tt) + nside * z * 0.75))
    d = once(d, {"_cap": cap, "_ntt": ntt, "_jp": jp, "_jm": jm})
    jp, jm, cap, ntt = F.col("_jp"), F.col("_jm"), F.col("_cap"), F.col("_ntt")
    fp, fm = F.call_function("shiftright", jp, F.lit(order)), F.call_function("shiftright", jm, F.lit(order))
    three, mask = F.lit(3).cast("long"), F.lit(nside - 1).cast("long")
    belt = F.when(fp == fm, fp.bitwiseAND(three) + 4).when(fp < fm, fp.bitwiseAND(three)).otherwise(fm.bitwiseAND(three) + 8)
    north = z >= 0
    d = once(
        d,
        {
            "_face": F.when(cap, F.when(north, ntt).otherwise(ntt + 8)).otherwise(belt),
            "_ix": F.when(cap, F.when(north, nside - jm - 1).otherwise(jp)).otherwise(jm.bitwiseAND(mask)),
            "_iy": F.when(cap, F.when(north, nside - jp - 1).otherwise(jm)).otherwise(nside - 1 - jp.bitwiseAND(mask)),
        },
    )
    pix = F.col("_face") * (nside * nside) + _spread(F.col("_ix"), 2).bitwiseOR(
        F.call_function("shiftleft", _spread(F.col("_iy"), 2), F.lit(1))
    )
    return d.withColumn(out, pix).drop("_z", "_tt", "_cap", "_ntt", "_jp", "_jm", "_face", "_ix", "_iy")


def sphere_centre(df: DataFrame, pix: str, order: int) -> DataFrame:
    """Pixel to the direction of its centre."""
    nside = 1 << order
    n2 = nside * nside
    p = F.col(pix)
    jrll = F.array(*[F.lit(v) for v in [2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4]])  # fixed values: ring of each face's south corner
    jpll = F.array(*[F.lit(v) for v in [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7]])  # fixed values: its longitude
    face = F.floor(p / n2).cast("int")
    inner = p % n2
    d = once(df, {"_f": face, "_ix": _compact(inner, 2), "_iy": _compact(F.call_function("shiftright", inner, F.lit(1)), 2)})
    jr = F.get(jrll, F.col("_f")) * nside - F.col("_ix") - F.col("_iy") - 1
    d = once(d, {"_jr": jr})
    jr = F.col("_jr")
    nr = F.when(jr < nside, jr).when(jr > 3 * nside, 4 * nside - jr).otherwise(nside)
    shift = F.when((jr < nside) | (jr > 3 * nside), 0).otherwise((jr - nside).bitwiseAND(F.lit(1).cast("long")))
    d = once(d, {"_nr": nr, "_ks": shift})
    nr, ks = F.col("_nr"), F.col("_ks")
    zz = (
        F.when(jr < nside, 1 - nr * nr / (3.0 * n2))
        .when(jr > 3 * nside, nr * nr / (3.0 * n2) - 1)
        .otherwise((2 * nside - jr) * 2 / (3.0 * nside))
    )
    jp = (F.get(jpll, F.col("_f")) * nr + F.col("_ix") - F.col("_iy") + 1 + ks) / 2
    jp = F.when(jp > 4 * nside, jp - 4 * nside).when(jp < 1, jp + 4 * nside).otherwise(jp)
    d = d.withColumn("theta_centre", F.acos(zz)).withColumn("phi_centre", (jp - (ks + 1) * 0.5) * (math.pi / 2 / nr))
    return d.drop("_f", "_ix", "_iy", "_jr", "_nr", "_ks")


def sphere_cell_key(pix: Column, order: int, hemisphere: Column) -> Column:
    """BR key of a pixel at an even order (one hex digit per two orders)."""
    if order % 2 or not 0 <= order <= 12:
        raise ValueError(f"BR orders are even and at most 12, got {order}")
    hemi = F.when(hemisphere == "R", F.lit(12 * fr.FACE_WIDTH)).otherwise(F.lit(0)).cast("long")
    lo = F.lit(fr.BR_START) + hemi + F.call_function("shiftleft", pix.cast("long"), F.lit(2 * (12 - order)))
    return lo * 16 + (order // 2 + 1)


def mean_cell_area_mm2(digits: int) -> float:
    return fr.CORTICAL_AREA_MM2 / (12 * 4 ** (2 * (digits - 1)))


# ---- affines --------------------------------------------------------------------


def apply_affine(m, x: Column, y: Column, z: Column) -> list[Column]:
    """3x4 matrix (numbers or Columns) applied to a point."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return [lit(r[0]) * x + lit(r[1]) * y + lit(r[2]) * z + lit(r[3]) for r in m]


def invert_affine(m):
    import numpy as np

    full = np.vstack([np.asarray(m, dtype=float), [0, 0, 0, 1]])
    return np.linalg.inv(full)[:3].tolist()


def axis_scales(m):
    import numpy as np

    return np.linalg.svd(np.asarray(m, dtype=float)[:, :3], compute_uv=False).tolist()
