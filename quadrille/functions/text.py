"""Text, colour and hash functions of workbook files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BAD = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]"
#: XML's own escapes. Fixed values.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def _pieces(text: Column, pattern: str, change) -> Column:
    """text with every match of a pattern changed: it is cut at the matches, which are put back between the pieces."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.zip_with(between, F.transform(found, change), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))


def decode_escapes(text: Column) -> Column:
    """_xHHHH_ as the character of that code."""
    return _pieces(text, "_x[0-9A-Fa-f]{4}_", lambda m: _char(F.conv(F.substring(m, 3, 4), 16, 10).cast("int")))


def _char(code: Column) -> Column:
    """The character of a code point below 65536, by its UTF-16 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def encode_escapes(text: Column) -> Column:
    """The inverse: what looks like an escape is protected, and characters that XML can't hold become escapes."""
    safe = F.regexp_replace(text, r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    return _pieces(safe, _BAD[:-1] + r"\r]", lambda c: F.concat(F.lit("_x"), F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0"), F.lit("_")))


def escape_xml(text: Column) -> Column:
    """Escaped for XML; characters that it can't hold are dropped."""
    out = F.regexp_replace(text, _BAD, "")
    for raw, entity in ENTITIES:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def unescape_xml(text: Column) -> Column:
    """Named and numbered entities as characters."""
    out = _pieces(text, r"&#(?:[0-9]{1,7}|x[0-9A-Fa-f]{1,6});", _code_point)
    for raw, entity in reversed(ENTITIES):
        out = F.replace(out, F.lit(entity), F.lit(raw))
    return out


def _code_point(entity: Column) -> Column:
    digits = F.regexp_extract(entity, "([0-9A-Fa-f]+);", 1)
    code = F.when(entity.contains("x"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
    high, low = 0xD800 + F.floor((code - 0x10000) / 0x400), 0xDC00 + (code - 0x10000) % 0x400
    wide = F.decode(F.unhex(F.concat(F.lpad(F.hex(high.cast("int")), 4, "0"), F.lpad(F.hex(low.cast("int")), 4, "0"))), "UTF-16BE")
    return F.when(code < 0x10000, _char(code)).otherwise(wide)


def odf_spaces(text: Column) -> Column:
    """Text as OpenDocument stores it: runs of spaces, tabs and line ends become elements (of escaped text)."""
    out = _pieces(F.regexp_replace(F.regexp_replace(escape_xml(text), "\t", "<text:tab/>"), "\n", "</text:p><text:p>"), " {2,}", lambda m: F.concat(F.lit(' <text:s text:c="'), (F.length(m) - 1).cast("string"), F.lit('"/>')))
    return F.concat(F.lit("<text:p>"), out, F.lit("</text:p>"))


def characters_of(length: Column) -> Column:
    """The column width in characters of an OpenDocument length such as 2.26cm; null if it is none."""
    value, unit = F.regexp_extract(length, r"^([\d.]+)", 1).try_cast("double"), F.regexp_extract(length, r"([a-z]+)$", 1)
    inches = {"in": 1.0, "cm": 1 / 2.54, "mm": 1 / 25.4, "pt": 1 / 72, "pc": 1 / 6, "px": 1 / 96}
    scale = F.lit(None).cast("double")
    for name, share in inches.items():
        scale = F.when(unit == name, share).otherwise(scale)
    pixels = value * scale * 96 - 5  # 96 pixels to the inch, 7 a character and 5 beside them
    return F.when(scale.isNotNull(), F.greatest(F.lit(0.0), F.round(pixels / 7, 2)))


def argb(color: Column) -> Column:
    """RRGGBB or AARRGGBB, with or without #, as AARRGGBB in capitals; null if it is none."""
    bare = F.upper(F.regexp_replace(color, "^#", ""))
    return F.when(bare.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("FF"), bare)).when(bare.rlike("^[0-9A-F]{8}$"), bare)


def tinted(rgb: Column, tint: Column) -> Column:
    """RRGGBB made lighter (tint above 0) or darker, in lightness of hue, saturation and lightness."""
    part = lambda k: F.conv(F.substring(rgb, k, 2), 16, 10).cast("double") / 255
    r, g, b = part(1), part(3), part(5)
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    light, spread = (hi + lo) / 2, hi - lo
    moved = F.when(tint < 0, light * (1 + tint)).otherwise(light * (1 - tint) + tint)
    # saturation is kept, so the spread follows from the new lightness, and each channel keeps its place in it
    room = lambda v: 1 - F.abs(2 * v - 1)
    wide = F.coalesce(F.try_divide(spread, room(light)), F.lit(0.0)) * room(moved)
    shade = lambda c: F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved + F.coalesce(F.try_divide(c - light, spread), F.lit(0.0)) * wide)) * 255 + 0.5)), 2, "0")
    return F.concat(shade(r), shade(g), shade(b))


def resolve_color(rgb: Column, theme: Column, indexed: Column, tint: Column, themes: list[str], palette: list[str]) -> Column:
    """The ARGB of a colour that is given directly, by theme slot or by palette index, with its tint."""
    named = lambda names, k: F.try_element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    base = F.coalesce(F.substring(argb(rgb), 3, 6), named(themes, theme), named(palette, indexed))
    return F.concat(F.lit("FF"), F.when(F.coalesce(tint, F.lit(0.0)) == 0, F.upper(base)).otherwise(tinted(base, tint)))


def sheet_password(password: Column) -> Column:
    """The 16-bit hash of a sheet's password, as four hexadecimal digits: characters, from the last, are mixed into a
    15-bit register that turns left by one."""
    turn = lambda h: F.shiftleft(h, 1).bitwiseAND(0x7FFF).bitwiseOR(F.shiftright(h, 14).bitwiseAND(1))
    letters = F.reverse(F.filter(F.split(password, ""), lambda c: c != ""))
    mixed = F.aggregate(letters, F.lit(0), lambda h, c: turn(h.bitwiseXOR(F.ascii(c))))
    return F.lpad(F.hex(mixed.bitwiseXOR(F.length(password)).bitwiseXOR(F.lit(0xCE4B))), 4, "0")


def image_size(content: Column) -> Column:
    """kind, width and height of a PNG or GIF from its head, and the kind alone of a JPEG; null of anything else."""
    h = F.hex(F.substring(content, 1, 32))
    number = lambda at, n: F.conv(F.substring(h, at * 2 + 1, n * 2), 16, 10).cast("int")
    little = lambda at: number(at, 1) + number(at + 1, 1) * 256
    none = F.lit(None).cast("int")
    row = lambda kind, w, high: F.struct(F.lit(kind).alias("kind"), w.alias("width"), high.alias("height"))
    return F.when(h.startswith("89504E470D0A1A0A"), row("png", number(16, 4), number(20, 4))).when(h.startswith("47494638"), row("gif", little(6), little(8))).when(h.startswith("FFD8FF"), row("jpeg", none, none))


def valid_name(name: Column) -> Column:
    """Whether a defined name may be used: letters, digits, _ . and \\, no look of a cell, not reserved."""
    word, cell, row_col = r"^[A-Za-z_\\][A-Za-z0-9_.\\]{0,254}$", r"^[A-Za-z]{1,3}[0-9]+$", r"^([Rr][0-9]*)?([Cc][0-9]*)?$"
    return F.coalesce(name.rlike(word) & ~name.rlike(cell) & ~name.rlike(row_col) & ~F.lower(name).startswith("_xlnm."), F.lit(False))


def text_units(text: Column) -> Column:
    """The length in UTF-16 units, which the cell limit of 32,767 counts."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))
