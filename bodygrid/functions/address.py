"""Address columns: canonical form, integer codes, hierarchy and text.

Everything here is a Column expression or a lazy DataFrame -> DataFrame
function, row-local, so the same code runs on a batch or a streaming frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodygrid import frames as fr
from bodygrid.functions.once import once


def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


def check_symbol(body: Column) -> Column:
    """Check symbol of a canonical body: sum of (2i+1)(index+1) mod 32.

    Unrolled over the longest canonical body (23 characters) so that it stays
    inside whole-stage codegen; the padding character has index 0.
    """
    padded = F.rpad(body, 24, "~")
    total = F.lit(0)
    for i in range(24):
        total = total + F.instr(F.lit(fr.CHECK_ALPHABET), F.substring(padded, i + 1, 1)) * (2 * i + 1)
    return F.when(body.isNotNull(), F.substring(F.lit(fr.CROCKFORD), (total % 32).cast("int") + 1, F.lit(1)))


def canonicalize(df: DataFrame, col: str, out: str = "cell", error: str = "error_code") -> DataFrame:
    """Add the canonical address, or the code of the first rule the input breaks."""
    raw = F.col(col)
    seg = lambda i: F.get(F.col("_seg"), F.lit(i))
    d = once(df, {"_t": F.upper(F.trim(raw))})
    d = once(
        d,
        {
            "_body": F.substring_index("_t", "~", 1),
            "_check": F.when(F.contains("_t", F.lit("~")), F.expr("substring(_t, instr(_t, '~') + 1)")),
        },
    )
    d = once(d, {"_seg": F.split("_body", "-", -1)})
    d = d.withColumn("_n", F.size("_seg")).withColumn("_frame", seg(0))
    anchors = F.when(F.col("_frame") == "BD", 2).otherwise(1)
    d = once(
        d,
        {
            "_n": F.col("_n"),
            "_frame": F.col("_frame"),
            "_digits": F.when(F.col("_n") == anchors + 2, F.element_at("_seg", -1)).otherwise(F.lit("")),
        },
    )
    digit_ok = F.when(F.col("_frame") == "BR", F.col("_digits").rlike("^[0-9A-F]*$")).otherwise(
        F.col("_digits").rlike("^[0-7]*$")
    )
    max_digits = F.when(F.col("_frame") == "BR", fr.MAX_DIGITS["BR"]).otherwise(fr.MAX_DIGITS["BD"])
    level_ok = seg(1).rlike("^[CTLS][0-9]{1,2}$")
    clock_num = F.expr("try_cast(regexp_extract(_seg[2], '^([0-9]{1,2})[IO]$', 1) AS INT)")
    d = once(
        d,
        {
            "_level": F.when(level_ok, F.concat(F.substring(seg(1), 1, 1), F.lpad(F.substring(seg(1), 2, 2), 2, "0"))),
            "_clock": F.when((F.col("_frame") == "BD") & (F.col("_n") >= 3), clock_num),
        },
    )
    canon = (
        F.when(
            F.col("_frame") == "BD",
            F.concat_ws(
                "-",
                F.lit("BD"),
                F.col("_level"),
                F.when(
                    F.col("_n") >= 3,
                    F.concat(F.lpad(F.col("_clock").cast("string"), 2, "0"), F.substring(seg(2), -1, 1)),
                ),
                F.when(F.col("_digits") != "", F.col("_digits")),
            ),
        ).otherwise(F.concat_ws("-", "_frame", seg(1), F.when(F.col("_digits") != "", F.col("_digits"))))
    )
    known = F.col("_frame").isin(*fr.MAX_DIGITS)
    is_bd, is_br = F.col("_frame") == "BD", F.col("_frame") == "BR"
    # Fixed order: each rule is only reached when every earlier one holds.
    code = (
        F.when(raw.isNull(), "bad_type")
        .when(raw.rlike("[^\\x20-\\x7e]"), "non_ascii")
        .when(F.col("_t") == "", "empty")
        .when(F.length("_t") > 64, "too_long")
        .when(
            F.col("_check").isNotNull()
            & ~((F.length("_check") == 1) & (F.instr(F.lit(fr.CROCKFORD), F.col("_check")) > 0)),
            "bad_check",
        )
        .when(F.col("_body").rlike("(^|-)(-|$)"), "empty_segment")
        .when(~F.col("_body").rlike("^[0-9A-Z-]+$"), "bad_segment")
        .when(~known, "unknown_frame")
        .when(F.col("_n") < 2, "missing_anchor")
        .when(F.col("_n") > anchors + 2, "too_many_segments")
        .when(F.length("_digits") > max_digits, "bad_precision")
        .when(~digit_ok, "bad_digit")
        .when(is_bd & (F.col("_level").isNull() | ~F.col("_level").isin(*fr.LEVELS)), "bad_level")
        .when(is_bd & (F.col("_n") >= 3) & ~F.coalesce(F.col("_clock").between(1, 12), F.lit(False)), "bad_azimuth")
        .when(~is_bd & ~seg(1).isin("L", "R"), "bad_hemisphere")
        .when(is_br & (F.col("_digits") == ""), "missing_digits")
        .when(is_br & F.col("_digits").rlike("^[C-F]"), "bad_base_face")
    )
    d = once(d, {"_code": code, "_canon": canon})
    checked = F.when(F.col("_code").isNotNull(), F.col("_code")).when(
        F.col("_check").isNotNull() & (F.col("_check") != check_symbol(F.col("_canon"))), "check_failed"
    )
    d = once(d, {error: checked})
    d = d.withColumn(out, F.when(F.col(error).isNull(), F.col("_canon")))
    return d.drop("_t", "_body", "_check", "_seg", "_n", "_frame", "_digits", "_level", "_clock", "_canon", "_code")


# ---- parts of a canonical address -----------------------------------------


def frame_of(cell: Column) -> Column:
    return F.substring(cell, 1, 2)


def _is(cell: Column, frame: str) -> Column:
    return frame_of(cell) == frame


def digits_of(cell: Column) -> Column:
    return F.when(_is(cell, "BD"), F.substring(cell, 12, 12)).otherwise(F.substring(cell, 6, 12))


def anchors_of(cell: Column) -> Column:
    """``T07`` or ``T07-03O`` for BD, the hemisphere otherwise."""
    return F.when(_is(cell, "BD"), F.substring(cell, 4, 7)).otherwise(F.substring(cell, 4, 1))


def rung_of(cell: Column) -> Column:
    """Steps below the frame root; for BR the base face is rung 1."""
    n = F.length(cell)
    return F.when(_is(cell, "BD"), F.when(n < 10, 0).otherwise(1 + F.greatest(n - 11, F.lit(0)))).otherwise(
        F.greatest(n - 5, F.lit(0))
    )


def level_of(cell: Column) -> Column:
    """The reported refinement level: rungs for BD and BV, HEALPix order for BR."""
    return F.when(_is(cell, "BR"), (rung_of(cell) - 1) * 2).otherwise(rung_of(cell))


def frame_root_of(cell: Column) -> Column:
    return F.when(_is(cell, "BD"), F.substring(cell, 1, 6)).when(_is(cell, "BV"), F.substring(cell, 1, 4)).otherwise(
        F.substring(cell, 1, 6)
    )


def is_experimental(cell: Column) -> Column:
    return ~frame_of(cell).isin(*fr.ENABLED_FRAMES)


def parent_of(cell: Column) -> Column:
    """Next coarser address, NULL at the frame root."""
    n = F.length(cell)
    bd = F.when(n <= 6, F.lit(None)).when(n == 10, F.substring(cell, 1, 6)).when(n == 12, F.substring(cell, 1, 10))
    bv = F.when(n <= 4, F.lit(None)).when(n == 6, F.substring(cell, 1, 4))
    br = F.when(n <= 6, F.lit(None))
    cut = F.substring(cell, F.lit(1), n - 1)
    return F.when(_is(cell, "BD"), bd.otherwise(cut)).when(_is(cell, "BV"), bv.otherwise(cut)).otherwise(br.otherwise(cut))


def demote(cell: Column, max_digits: int | Column) -> Column:
    """Cut to at most ``max_digits`` refinement digits; anchors are kept."""
    k = F.lit(max_digits) if isinstance(max_digits, int) else max_digits
    stem = F.when(_is(cell, "BD"), 10).otherwise(4)
    k = F.when(_is(cell, "BR"), F.greatest(k, F.lit(1))).otherwise(k)
    keep = F.when(k <= 0, stem).otherwise(stem + 1 + k)
    return F.substring(cell, F.lit(1), keep.cast("int"))


def ancestors_of(cell: Column, include_self: bool = False) -> Column:
    """Containing addresses, frame root first."""
    n = F.length(cell)
    head = F.when(
        _is(cell, "BD"),
        F.when(n >= 10, F.array(F.substring(cell, 1, 6), F.substring(cell, 1, 10))).otherwise(F.array(cell)),
    ).when(_is(cell, "BV"), F.array(F.substring(cell, 1, 4))).otherwise(F.array().cast("array<string>"))
    stem = F.when(_is(cell, "BD"), 11).otherwise(5)
    tail = F.when(n > stem, F.transform(F.sequence(stem + 1, n), lambda k: F.substring(cell, F.lit(1), k))).otherwise(
        F.array().cast("array<string>")
    )
    chain = F.concat(head, tail)
    return chain if include_self else F.filter(chain, lambda c: c != cell)


def children_of(cell: Column) -> Column:
    """Immediate children, in address order; empty at the digit cap."""
    halves = _lit_array([f"{c:02d}{h}" for c in range(1, 13) for h in "IO"])
    n = F.length(cell)
    digits = F.length(digits_of(cell))
    sep = F.when(digits > 0, "").otherwise("-")
    octal = F.transform(_lit_array(list("01234567")), lambda x: F.concat(cell, sep, x))
    hexa = F.transform(_lit_array(list("0123456789ABCDEF")), lambda x: F.concat(cell, sep, x))
    none = F.array().cast("array<string>")
    return (
        F.when(_is(cell, "BD") & (n == 6), F.transform(halves, lambda x: F.concat(cell, F.lit("-"), x)))
        .when(_is(cell, "BR"), F.when(digits < 7, hexa).otherwise(none))
        .otherwise(F.when(digits < 12, octal).otherwise(none))
    )


# ---- the integer line -------------------------------------------------------


def cell_lo(cell: Column) -> Column:
    octal = F.conv(F.rpad(digits_of(cell), 12, "0"), 8, 10).cast("long")
    level = (F.array_position(_lit_array(fr.LEVELS), F.substring(cell, 4, 3)) - 1).cast("long")
    sector = F.when(
        F.length(cell) >= 10,
        (F.substring(cell, 8, 2).cast("long") - 1) * 2 + F.when(F.substring(cell, 10, 1) == "O", 1).otherwise(0),
    ).otherwise(F.lit(0))
    hemi = F.when(F.substring(cell, 4, 1) == "R", F.lit(1)).otherwise(F.lit(0)).cast("long")
    hexa = F.conv(F.rpad(digits_of(cell), 7, "0"), 16, 10).cast("long")
    return (
        F.when(_is(cell, "BD"), (level * 24 + sector) * F.lit(fr.OCT12) + octal)
        .when(_is(cell, "BV"), F.lit(fr.BV_START) + hemi * F.lit(fr.OCT12) + octal)
        .otherwise(F.lit(fr.BR_START) + hemi * F.lit(12 * fr.FACE_WIDTH) + hexa)
    )


def width_at(lo: Column, rung: Column) -> Column:
    """Width of the cell at ``rung`` in the frame that ``lo`` lies in."""
    one = F.lit(1).cast("long")
    shift = lambda bits: F.call_function("shiftleft", one, bits.cast("int"))
    bits = F.when(lo < fr.BV_START, 39 - rung * 3).when(lo < fr.BR_START, 36 - rung * 3).otherwise(28 - rung * 4)
    return F.when((rung == 0) & (lo < fr.BV_START), F.lit(fr.BD_LEVEL_WIDTH)).otherwise(shift(bits))


def root_width_at(lo: Column) -> Column:
    return F.when(lo < fr.BV_START, F.lit(fr.BD_LEVEL_WIDTH)).when(lo < fr.BR_START, F.lit(fr.OCT12)).otherwise(
        F.lit(fr.FACE_WIDTH)
    )


def key_at(lo: Column, rung: Column) -> Column:
    """Key of the cell at ``rung`` that contains ``lo``."""
    bits = F.when(lo < fr.BV_START, 39 - rung * 3).when(lo < fr.BR_START, 36 - rung * 3).otherwise(28 - rung * 4)
    cut = F.call_function("shiftleft", F.call_function("shiftright", lo, bits), bits)
    level = lo - lo % fr.BD_LEVEL_WIDTH
    return F.when((rung == 0) & (lo < fr.BV_START), level).otherwise(cut) * 16 + rung


def key_lo(key: Column) -> Column:
    return F.call_function("shiftright", key, F.lit(4))


def key_rung(key: Column) -> Column:
    return key.bitwiseAND(F.lit(15)).cast("int")


def key_width(key: Column) -> Column:
    return width_at(key_lo(key), key_rung(key))


def cell_key(cell: Column) -> Column:
    return cell_lo(cell) * 16 + rung_of(cell)


def first_rung(lo: Column) -> Column:
    return F.when(lo < fr.BR_START, 0).otherwise(1)


def ancestor_keys(key: Column, include_self: bool, rungs: Column | None = None) -> Column:
    """Keys of the containing cells, optionally only at the rungs in ``rungs``."""
    lo, rung = key_lo(key), key_rung(key)
    last = rung if include_self else rung - 1
    steps = F.when(last >= first_rung(lo), F.sequence(first_rung(lo), last)).otherwise(F.array().cast("array<int>"))
    if rungs is not None:
        steps = F.array_intersect(steps, rungs)
    return F.transform(steps, lambda r: key_at(lo, r))


def cell_text(key: Column) -> Column:
    """Canonical text of a key."""
    lo, rung = key_lo(key), key_rung(key)
    octal = F.lpad(F.conv((lo % F.lit(fr.OCT12)).cast("string"), 10, 8), 12, "0")
    unit = F.call_function("shiftright", lo, F.lit(36))
    sector = unit % 24
    level = F.element_at(_lit_array(fr.LEVELS), ((unit - sector) / 24).cast("int") + 1)
    azimuth = F.concat(
        F.lpad((F.floor(sector / 2) + 1).cast("string"), 2, "0"), F.when(sector % 2 == 1, "O").otherwise("I")
    )
    bd = F.concat_ws(
        "-",
        F.lit("BD"),
        level,
        F.when(rung >= 1, azimuth),
        F.when(rung >= 2, F.substring(octal, F.lit(1), rung - 1)),
    )
    bv = F.concat_ws(
        "-",
        F.lit("BV"),
        F.when(unit == 768, "L").otherwise("R"),
        F.when(rung >= 1, F.substring(octal, F.lit(1), rung)),
    )
    off = lo - F.lit(fr.BR_START)
    half = F.lit(12 * fr.FACE_WIDTH)
    hexa = F.lpad(F.conv((off % half).cast("string"), 10, 16), 7, "0")
    br = F.concat_ws("-", F.lit("BR"), F.when(off < half, "L").otherwise("R"), F.substring(hexa, F.lit(1), rung))
    return F.when(lo < fr.BV_START, bd).when(lo < fr.BR_START, bv).when(lo.isNotNull(), br)


def with_key(df: DataFrame, cell: str = "cell", out: str = "cell_key") -> DataFrame:
    return once(df, {out: cell_key(F.col(cell))})


# ---- pairwise predicates ------------------------------------------------------


def contains(outer_key: Column, inner_key: Column) -> Column:
    o, i = key_lo(outer_key), key_lo(inner_key)
    return (o <= i) & (i + key_width(inner_key) <= o + key_width(outer_key)) & (key_rung(outer_key) <= key_rung(inner_key))


def overlaps(a_key: Column, b_key: Column) -> Column:
    return contains(a_key, b_key) | contains(b_key, a_key)


def relative_measure(outer_key: Column, inner_key: Column) -> Column:
    return F.when(contains(outer_key, inner_key), key_width(inner_key) / key_width(outer_key)).otherwise(F.lit(0.0))


def prefix_range(address: str) -> tuple[str, str]:
    """Half-open text range holding exactly the cells at or below one address."""
    return address, address[:-1] + chr(ord(address[-1]) + 1)


def describe_columns(cell: Column) -> dict[str, Column]:
    return {
        "frame": frame_of(cell),
        "anchors": F.split(anchors_of(cell), "-"),
        "digits": digits_of(cell),
        "level": level_of(cell),
        "experimental": is_experimental(cell),
    }
