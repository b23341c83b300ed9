"""Colour columns: normal form, colour spaces, distances, families, colour-blind simulation, device CMYK, lengths.

Everything here is a built-in Spark expression. Rounding is half-even. Inputs that are no colour give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .css_names import NAMES, NO_COLOUR

#: The functional notation: three channels, each a number or a percentage, set apart by a comma, blanks or nothing; then
#: perhaps an alpha value after a comma or a slash.
NUMBER = r"-?[0-9]+(?:[.][0-9]+)?%?"
_GAP = r"\s*,?\s*"
RGB = r"rgba?[(]\s*" + _GAP.join([f"({NUMBER})"] * 3) + rf"(?:\s*[,/]\s*{NUMBER})?\s*[)]"
FAMILIES = ("red", "orange", "yellow", "green", "cyan", "blue", "purple", "neutral")
CB_TYPES = ("deutan", "protan", "tritan", "achromat")
#: Machado et al. 2009, severity 1.0, on linear RGB. Fixed values.
MACHADO = {
    "protan": ((0.152286, 1.052583, -0.204868), (0.114503, 0.786281, 0.099216), (-0.003882, -0.048116, 1.051998)),
    "deutan": ((0.367322, 0.860646, -0.227968), (0.280085, 0.672501, 0.047413), (-0.011820, 0.042940, 0.968881)),
    "tritan": ((1.255528, -0.076749, -0.178779), (-0.078411, 0.930809, 0.147602), (0.004733, 0.691367, 0.303900)),
}
#: sRGB (D65) to XYZ and the reference white. Fixed values.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (95.047, 100.0, 108.883)
LUMA = (0.2126, 0.7152, 0.0722)


def _names() -> Column:
    return F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))


def format_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def normalize_hex(raw: Column) -> Column:
    """Any CSS paint value as #RRGGBB, or null."""
    v = F.trim(raw)
    low = F.lower(v)
    body = F.upper(F.substring(v, 2, 8))
    short = F.concat(F.lit("#"), *(F.repeat(F.substring(body, i, 1), 2) for i in (1, 2, 3)))
    hexed = F.when(v.rlike("^#([0-9a-fA-F]{3}|[0-9a-fA-F]{4})$"), short).when(v.rlike("^#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"),
        F.concat(F.lit("#"), F.substring(body, 1, 6)))

    def channel(i: int) -> Column:
        text = F.regexp_extract(v, f"(?i)^{RGB}$", i)
        number = F.regexp_replace(text, "%", "").try_cast("double")
        scaled = F.when(text.endswith("%"), number * 255 / 100).otherwise(number)
        return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(scaled)))

    rgb = format_hex(channel(1), channel(2), channel(3))
    return (
        F.when((low == "") | low.isin(*NO_COLOUR) | low.startswith("url("), F.lit(None))
        .when(v.startswith("#"), hexed)
        .when(v.rlike(f"(?i)^{RGB}$"), rgb)
        .otherwise(F.try_element_at(_names(), low))
    )


def css_color_tokens(text: Column) -> Column:
    """Array of struct(raw, hex) in free CSS: hex forms, then rgb() forms, then names outside both."""
    hexes = F.regexp_extract_all(text, F.lit(r"(#[0-9a-fA-F]{3,8})\b"), F.lit(1))
    rgbs = F.regexp_extract_all(text, F.lit(f"(?i)({RGB})"), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace(text, f"(?i){RGB}", " "), r"#[0-9a-fA-F]{3,8}\b", " ")
    words = F.regexp_extract_all(rest, F.lit(r"\b([a-zA-Z]{3,30})\b"), F.lit(1))
    all_ = F.transform(F.concat(hexes, rgbs, words), lambda x: F.struct(x.alias("raw"), normalize_hex(x).alias("hex")))
    return F.filter(all_, lambda x: x["hex"].isNotNull())


def parse_style(text: Column) -> Column:
    """Array of struct(prop, value) of an inline style, in order."""
    parts = F.filter(F.split(text, ";"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("prop"),
        F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    return F.filter(pairs, lambda x: (x["prop"] != "") & (x["value"] != ""))


def channels(hex_: Column) -> tuple[Column, Column, Column]:
    """M1: red, green, blue; null unless #RRGGBB."""
    fine = hex_.rlike("^#[0-9a-fA-F]{6}$")
    return tuple(F.when(fine, F.conv(F.substring(hex_, i, 2), 16, 10).cast("int")) for i in (2, 4, 6))


def hex_to_rgb(hex_: Column) -> Column:
    r, g, b = channels(hex_)
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def linear(c: Column) -> Column:
    a = c / 255.0
    return F.when(a <= 0.04045, a / 12.92).otherwise(F.pow((a + 0.055) / 1.055, F.lit(2.4)))


def _to_white(v) -> list[Column]:
    return [(v[0] * row[0] + v[1] * row[1] + v[2] * row[2]) * 100.0 / w for row, w in zip(TO_XYZ, WHITE, strict=True)]


def _axis(x: Column) -> Column:
    return F.when(x > (6 / 29) ** 3, F.pow(x, F.lit(1 / 3))).otherwise(x / (3 * (6 / 29) ** 2) + 4 / 29)


def _lab(f) -> tuple[Column, Column, Column]:
    return (f[1] * 116.0 - 16.0).alias("L"), ((f[0] - f[1]) * 500.0).alias("a"), ((f[1] - f[2]) * 200.0).alias("b")


def lab_of_rgb(rgb: Column) -> Column:
    """rgb: array of three channels. Struct L, a, b."""
    lin = F.transform(rgb, linear)
    return let(let(lin, lambda v: F.transform(F.array(*_to_white(v)), _axis)), lambda f: F.struct(*_lab(f)))


def hex_to_lab(hex_: Column) -> Column:
    """M2: struct L, a, b (CIE 1976, D65)."""
    return lab_of_rgb(let(hex_, lambda h: F.array(*channels(h))))


def lab_columns(hex_: Column) -> tuple[Column, Column, Column]:
    lab = hex_to_lab(hex_)
    return lab["L"], lab["a"], lab["b"]


def _length(parts) -> Column:
    return let(F.array(*parts), lambda d: F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))


def lab_distance(p: Column, q: Column) -> Column:
    """M3 on two Lab structs."""
    return let(F.struct(p.alias("p"), q.alias("q")), lambda x: _length([x["p"][k] - x["q"][k] for k in ("L", "a", "b")]))


def delta_e76(one: Column, other: Column) -> Column:
    return lab_distance(hex_to_lab(one), hex_to_lab(other))


def rgb_distance(one: Column, other: Column) -> Column:
    """M4."""
    return _length([(x - y).cast("double") for x, y in zip(channels(one), channels(other), strict=True)])


def color_distance(one: Column, other: Column, metric: str = "lab") -> Column:
    """M5."""
    if metric not in ("lab", "rgb"):
        raise ValueError(f"metric must be lab or rgb, not {metric!r}")
    return delta_e76(one, other) if metric == "lab" else rgb_distance(one, other)


def is_grayscale(hex_: Column, tolerance: int = 2) -> Column:
    """M6."""
    c = channels(hex_)
    return F.greatest(*c) - F.least(*c) <= tolerance


def gray_value(hex_: Column) -> Column:
    """M7: Rec. 709 luma on gamma values."""
    r, g, b = channels(hex_)
    return F.rint(r * LUMA[0] + g * LUMA[1] + b * LUMA[2]).cast("int")


def family_of(lab: Column) -> Column:
    """M8 on a Lab struct."""
    bins = (("red", 50), ("orange", 80), ("yellow", 115), ("green", 200), ("cyan", 250), ("blue", 310), ("purple", 340))

    def by_angle(angle: Column) -> Column:
        out = F.when(angle.isNull(), F.lit(None).cast("string"))
        for name, below in bins:
            out = out.when(angle < below, name)
        return out.otherwise("red")

    angle = F.pmod(F.degrees(F.atan2(lab["b"], lab["a"])), F.lit(360.0))
    return F.when(F.sqrt(lab["a"] * lab["a"] + lab["b"] * lab["b"]) < 8, "neutral").otherwise(let(angle, by_angle))


def hue_family(hex_: Column) -> Column:
    """M8."""
    return let(hex_to_lab(hex_), family_of)


def label_of(lab: Column) -> Column:
    neutral = F.when(lab["L"] > 85, "near white").when(lab["L"] < 15, "near black").otherwise("neutral gray")
    tint = F.when(lab["L"] > 75, "light ").when(lab["L"] < 35, "dark ").otherwise("")
    return let(family_of(lab), lambda f: F.when(f == "neutral", neutral).otherwise(F.concat(tint, f)))


def auto_label(hex_: Column) -> Column:
    """M9."""
    return let(hex_to_lab(hex_), label_of)


def color_sort_key(hex_: Column) -> Column:
    """Struct of family index, L, a, b."""
    index = lambda lab: F.array_position(F.array(*map(F.lit, FAMILIES)), family_of(lab))
    return let(hex_to_lab(hex_), lambda lab: F.struct(index(lab).alias("family"), lab["L"].alias("L"), lab["a"].alias("a"), lab["b"].alias("b")))


def _clip(x: Column, top: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(top), x))


def _luma(v) -> Column:
    return v[0] * LUMA[0] + v[1] * LUMA[1] + v[2] * LUMA[2]


def _grayed(c: Column, luma: Column, s: float) -> Column:
    return F.rint(_clip(c * (1 - s) + luma * s, 255.0))


def _seen(v, kind: str, s: float) -> list[Column]:
    """Linear channels as seen with a deficiency of severity s."""
    rows = [[(1 - s) * (i == j) + s * row[j] for j in range(3)] for i, row in enumerate(MACHADO[kind])]
    return [_clip(v[0] * m[0] + v[1] * m[1] + v[2] * m[2], 1.0) for m in rows]


def _channel(c: Column) -> Column:
    """The channel (0 to 255) of a linear one."""
    gamma = F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)
    return F.rint(_clip(gamma * 255.0, 255.0))


def _severity(severity: float) -> float:
    return min(1.0, max(0.0, float(severity)))


def simulate_rgb(rgb: Column, kind: str, severity: float = 1.0) -> Column:
    """M11 on an array of three channels: the channels seen. Double precision throughout."""
    s = _severity(severity)
    if kind == "normal":
        return F.transform(rgb, lambda c: c.cast("double"))
    if kind == "achromat":
        return let(rgb, lambda v: F.transform(v, lambda c: _grayed(c, _luma(v), s)))
    if kind not in MACHADO:
        raise ValueError(f"unknown kind {kind!r}")
    seen = let(F.transform(rgb, linear), lambda v: F.array(*_seen(v, kind, s)))
    return F.transform(seen, _channel)


def with_places(df: DataFrame, severity: float = 1.0) -> DataFrame:
    """df with column hex -> df and place: Lab of hex (L, a, b) and of what each of CB_TYPES sees (L_deutan, ...), one struct of
    doubles. The formulas of lab_of_rgb and simulate_rgb, in steps of plain columns that Spark compiles: for places by the row."""
    s, kept, sides = _severity(severity), [F.col(f"`{c}`") for c in df.columns], ("", *(f"_{k}" for k in CB_TYPES))
    three = lambda name, side="": [F.col(f"_{name}{side}{i}") for i in range(3)]
    named = lambda cols, name, side="": [c.alias(f"_{name}{side}{i}") for i, c in enumerate(cols)]
    out = df.select(*kept, *named(channels(F.col("hex")), "c"))
    out = out.select(*kept, *three("c"), *named(map(linear, three("c")), "l"))
    machado = [k for k in CB_TYPES if k != "achromat"]
    out = out.select(*kept, *three("c"), *three("l"), *(c for k in machado for c in named(_seen(three("l"), k, s), "v", f"_{k}")))
    gray = [_grayed(c, _luma(three("c")), s) for c in three("c")]
    out = out.select(*kept, *three("l"), *named(gray, "r", "_achromat"), *(c for k in machado for c in named(map(_channel, three("v", f"_{k}")), "r", f"_{k}")))
    out = out.select(*kept, *three("l"), *(c for k in CB_TYPES for c in named(map(linear, three("r", f"_{k}")), "l", f"_{k}")))
    out = out.select(*kept, *(c for side in sides for c in named(_to_white(three("l", side)), "w", side)))
    out = out.select(*kept, *(c for side in sides for c in named(map(_axis, three("w", side)), "f", side)))
    return out.select(*kept, F.struct(*(c.alias(f"{n}{side}") for side in sides for n, c in zip("Lab", _lab(three("f", side)), strict=True))).alias("place"))


def place_distance(p: str | Column, q: str | Column, side: str = "") -> Column:
    """M3 on two columns of with_places()."""
    p, q = (F.col(v) if isinstance(v, str) else v for v in (p, q))
    d = [p[f"{k}{side}"] - q[f"{k}{side}"] for k in "Lab"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def simulate_cb(hex_: Column, kind: str, severity: float = 1.0) -> Column:
    """The colour as seen with a colour-vision deficiency."""
    rgb = let(hex_, lambda h: F.array(*channels(h)))
    shown = lambda c: let(simulate_rgb(c, kind, severity), lambda v: format_hex(v[0], v[1], v[2]))
    return let(rgb, lambda c: F.when(c[0].isNotNull(), shown(c)))


def delta_band(d: Column, scale: str = "palette") -> Column:
    """M12."""
    if scale == "palette":
        return F.when(d.isNull(), "unavailable").when(d <= 2, "ok").when(d <= 5, "review").otherwise("flag")
    return F.when(d.isNull(), "unavailable").when(d >= 6, "warn").when(d >= 2, "slight").otherwise("in gamut")


def cmyk_struct(c: Column, m: Column, y: Column, k: Column) -> Column:
    """A quad of percentages, or null when one is missing or outside 0..100."""
    fine = lambda q: F.forall(q, lambda x: F.coalesce(x.between(0, 100), F.lit(False)))
    named = lambda q: F.struct(*(q[i].alias(n) for i, n in enumerate("cmyk")))
    return let(F.array(*(x.cast("double") for x in (c, m, y, k))), lambda q: F.when(fine(q), named(q)))


def parse_cmyk(text: Column) -> Column:
    """M13: "c/m/y/k" or "c,m,y,k", or the same as JSON: a text, a list of four, or an object (what it lacks is 0)."""
    plain = F.coalesce(F.when(text.rlike(r'^\s*"'), F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]), text)
    parts = F.transform(F.split(F.translate(plain, ", []", "/"), "/"), lambda x: x.try_cast("double"))
    listed = let(parts, parse_cmyk_array)
    named = F.from_json(text, "map<string,string>")
    return F.when(text.rlike(r"^\s*[{]"), parse_cmyk_map(named)).otherwise(listed)


def parse_cmyk_map(parts: Column) -> Column:
    """M13 on a map with keys c, m, y, k in either case; missing ones are 0."""
    value = lambda p, k: F.coalesce(F.try_element_at(p, F.lit(k)), F.try_element_at(p, F.lit(k.upper())), F.lit("0")).try_cast("double")
    return let(parts, lambda p: F.when(p.isNotNull(), cmyk_struct(*(value(p, k) for k in "cmyk"))))


def parse_cmyk_array(parts: Column) -> Column:
    """M13 on an array of four numbers."""
    return F.when(F.size(parts) == 4, cmyk_struct(*(F.get(parts, F.lit(i)).cast("double") for i in range(4))))


def cmyk_label(quad: Column) -> Column:
    def text(x: Column) -> Column:
        whole = F.abs(x - F.rint(x)) < 1e-9
        return F.when(whole, F.rint(x).cast("long").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$",
            ""), r"\.$", ""))

    return let(quad, lambda q: F.array_join(F.transform(F.array(*(q[n] for n in "cmyk")), text), "/"))


def parse_length_pt(raw: Column, per_pt: Column) -> Column:
    """An SVG length in points."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)([a-zA-Z%]*)\s*$"
    n, unit = F.regexp_extract(raw, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(raw, pattern, 2))
    known = F.when(unit.isin("", "px"), F.when(per_pt > 0, F.try_divide(n, per_pt))).when(unit == "pt", n).when(unit == "mm",
        n * 72.0 / 25.4).when(unit == "cm", n * 72.0 / 2.54).when(unit == "in", n * 72.0)
    return F.when(raw.rlike(pattern), known)


def viewbox(text: Column) -> Column:
    """Array of four doubles, or null."""
    parts = F.transform(F.split(F.trim(F.regexp_replace(text, ",", " ")), r"\s+"), lambda x: x.try_cast("double"))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull()), parts)


def user_units_per_pt(viewbox_text: Column, trim_width: float) -> Column:
    """M15."""
    width = F.get(viewbox(viewbox_text), F.lit(2))
    if trim_width <= 0:
        return F.lit(96.0 / 72.0)
    return F.when(width > 0, width / trim_width / 72.0).otherwise(F.lit(96.0 / 72.0))
