"""Addresses as text people read and say, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bodygrid import frames as fr
from bodygrid.functions import address as ad
from bodygrid.functions.once import once

# The spoken vocabulary.
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
CLOCK_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
LETTER_WORDS = {"A": "alpha", "B": "bravo", "C": "charlie", "D": "delta", "E": "echo", "F": "foxtrot"}
MAX_READABLE = 512
MAX_PARTS = 8


def _map(pairs: dict[str, str]) -> Column:
    flat = []
    for k, v in pairs.items():
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def _level_phrase(cell: Column) -> Column:
    return F.concat(F.substring(cell, 4, 1), F.substring(cell, 5, 2).cast("int").cast("string"), F.lit(" level"))


def _clock_word(cell: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in CLOCK_WORDS]), F.substring(cell, 8, 2).cast("int") - 1)


def _depth_word(cell: Column) -> Column:
    return F.when(F.substring(cell, 10, 1) == "I", "inner").otherwise("outer")


def _side(cell: Column) -> Column:
    return F.when(F.substring(cell, 4, 1) == "L", "left").otherwise("right")


def _parts(cell: Column, run: Column) -> Column:
    frame = ad.frame_of(cell)
    digits = ad.digits_of(cell)
    tail = F.when(digits != "", F.concat(F.lit("cell "), run))
    has_clock = F.length(cell) >= 10
    bd = F.concat_ws(
        ", ",
        F.lit("body"),
        _level_phrase(cell),
        F.when(has_clock, F.concat(_clock_word(cell), F.lit(" o'clock"))),
        F.when(has_clock, _depth_word(cell)),
        tail,
    )
    bv = F.concat_ws(", ", F.lit("brain"), F.concat(_side(cell), F.lit(" hemisphere")), tail)
    br = F.concat_ws(", ", F.concat(_side(cell), F.lit(" cortical surface")), tail)
    return F.when(frame == "BD", bd).when(frame == "BV", bv).when(frame == "BR", br)


def to_readable(cell: Column) -> Column:
    return _parts(cell, ad.digits_of(cell))


def to_spoken(cell: Column) -> Column:
    words = {str(i): w for i, w in enumerate(DIGIT_WORDS)} | LETTER_WORDS
    spelled = F.concat_ws(" ", F.transform(F.split(ad.digits_of(cell), ""), lambda c: _map(words)[c]))
    return _parts(cell, spelled)


def from_readable(df: DataFrame, col: str, out: str = "cell", error: str = "error_code") -> DataFrame:
    """Clean dictated or scanned text into addresses, or say which rule it breaks first."""
    words = {w: str(i) for i, w in enumerate(DIGIT_WORDS)} | {w: s for s, w in LETTER_WORDS.items()}
    words |= {"oh": "0", "niner": "9"}
    numbers = {w: str(i + 1) for i, w in enumerate(CLOCK_WORDS)} | {"zero": "0", "oh": "0", "niner": "9"}
    word_map, number_map = _map(words), _map(numbers)
    raw = F.col(col)

    def number(token: Column) -> Column:
        return F.when(token.rlike("^[0-9]{1,2}$"), token.cast("int")).otherwise(number_map[token].cast("int"))

    def digits(phrase: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(phrase, "^cells?\\s+", ""), "^number\\s+", "")
        tokens = F.filter(F.split(body, "[\\s-]+"), lambda t: t != "")
        return F.concat_ws("", F.transform(tokens, lambda t: F.coalesce(word_map[t], F.upper(t))))

    clauses = F.filter(
        F.transform(
            F.split(F.translate(F.lower(raw), ".;", ",,"), ","),
            lambda p: F.regexp_replace(F.regexp_replace(p, "(?U)^\\s+|\\s+$", ""), "(?U)\\s+", " "),
        ),
        lambda p: p != "",
    )
    # Text past the cap is rejected on its length alone and never split.
    d = once(df, {"_p": F.when(F.length(raw) <= MAX_READABLE, clauses)})
    part = lambda i: F.coalesce(F.get("_p", F.lit(i)), F.lit(""))
    level_re = "^(c|t|l|s|cervical|thoracic|lumbar|sacral)\\s*-?\\s*([a-z0-9]+?)(?:\\s+level)?$"
    clock_re = "^([a-z0-9]+)\\s*(?:o\\s*'?\\s*clock|oclock)$"
    d = once(
        d,
        {
            "_n": F.size("_p"),
            "_h": part(0),
            "_surface": F.regexp_extract(part(0), "^(left|right|l|r)\\s+(?:cortical\\s+surface|cortex|surface)$", 1),
            "_hemi": F.regexp_extract(part(1), "^(left|right|l|r)(?:\\s+hemisphere)?$", 1),
            "_lv": F.upper(F.substring(F.regexp_extract(part(1), level_re, 1), 1, 1)),
            "_ln": number(F.regexp_extract(part(1), level_re, 2)),
            "_ck": number(F.regexp_extract(part(2), clock_re, 1)),
            "_dp": F.when(part(3).isin("inner", "i"), "I").when(part(3).isin("outer", "o"), "O"),
        },
    )
    d = once(
        d,
        {
            "_kind": F.when(F.col("_surface") != "", "BR")
            .when(F.col("_h").isin("brain", "brain volume"), "BV")
            .when(F.col("_h") == "body", "BD"),
            "_label": F.when(
                (F.col("_lv") != "") & F.col("_ln").isNotNull(),
                F.concat("_lv", F.lpad(F.col("_ln").cast("string"), 2, "0")),
            ),
        },
    )
    kind, n = F.col("_kind"), F.col("_n")
    run = F.when(kind == "BR", part(1)).when(kind == "BV", part(2)).otherwise(part(4))
    has_run = F.when(kind == "BR", n == 2).when(kind == "BV", n == 3).otherwise(n == 5)
    d = once(d, {"_run": F.when(has_run, digits(run))})
    cap = F.when(kind == "BR", fr.MAX_DIGITS["BR"]).otherwise(fr.MAX_DIGITS["BD"])
    code = (
        F.when(raw.isNull(), "bad_type")
        .when(F.length(raw) > MAX_READABLE, "too_long")
        .when(n == 0, "empty")
        .when(n > MAX_PARTS, "too_many_segments")
        .when(kind.isNull(), "unknown_frame")
        .when((kind == "BR") & (n != 2), "missing_digits")
        .when((kind != "BR") & (n == 1), "missing_anchor")
        .when((kind == "BV") & (F.col("_hemi") == ""), "bad_hemisphere")
        .when((kind == "BV") & (n > 3), "too_many_segments")
        .when((kind == "BD") & ~F.coalesce(F.col("_label").isin(*fr.LEVELS), F.lit(False)), "bad_level")
        .when((kind == "BD") & (n > 2) & F.col("_ck").isNull(), "bad_azimuth")
        .when((kind == "BD") & (n == 3), "missing_anchor")
        .when((kind == "BD") & (n > 3) & F.col("_dp").isNull(), "bad_azimuth")
        .when((kind == "BD") & (n > 5), "too_many_segments")
        .when(has_run & (F.col("_run") == ""), "bad_digit")
        .when(has_run & (F.length("_run") > cap), "bad_precision")
    )
    side = F.upper(F.substring(F.when(kind == "BR", F.col("_surface")).otherwise(F.col("_hemi")), 1, 1))
    text = F.when(
        kind == "BD",
        F.concat_ws(
            "-",
            F.lit("BD"),
            F.col("_label"),
            F.when(n > 2, F.concat(F.lpad(F.col("_ck").cast("string"), 2, "0"), F.col("_dp"))),
            F.col("_run"),
        ),
    ).otherwise(F.concat_ws("-", kind, side, F.col("_run")))
    d = once(d, {"_rule": code, "_text": text})
    d = ad.canonicalize(d, "_text", out, "_parse")
    d = d.withColumn(error, F.coalesce("_rule", "_parse")).withColumn(out, F.when(F.col("_rule").isNull(), F.col(out)))
    return d.drop("_p", "_n", "_h", "_surface", "_hemi", "_lv", "_ln", "_ck", "_dp", "_kind", "_label", "_run", "_rule", "_text", "_parse")


def describe(df: DataFrame, cell: str = "cell") -> DataFrame:
    """One row per labelled part of each address."""
    c = F.col(cell)
    frame, digits = ad.frame_of(c), ad.digits_of(c)
    frame_label = F.when(frame == "BD", "body").when(frame == "BV", "brain volume").otherwise("cortical surface")
    side_label = F.concat(_side(c), F.when(frame == "BR", " cortical surface").otherwise(" hemisphere"))
    row = lambda seg, kind, label: F.struct(seg.alias("segment"), F.lit(kind).alias("kind"), label.alias("label"))
    parts = F.array(
        row(frame, "frame", frame_label),
        F.when(frame == "BD", row(F.substring(c, 4, 3), "level", _level_phrase(c))).otherwise(
            row(F.substring(c, 4, 1), "hemisphere", side_label)
        ),
        F.when(
            (frame == "BD") & (F.length(c) >= 10),
            row(F.substring(c, 8, 3), "azimuth", F.concat(_clock_word(c), F.lit(" o'clock, "), _depth_word(c))),
        ),
        F.when(digits != "", row(digits, "refinement", F.concat(F.lit("cell "), digits))),
    )
    return df.select(cell, F.posexplode(F.array_compact(parts)).alias("pos", "part")).select(cell, "pos", "part.*")
