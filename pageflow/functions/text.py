"""Strings of code points: notation, white space, reversal, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space for text cleaning (Unicode white space and the four separators 1C-1F), and
# the marks that have no width.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]"
INVISIBLE = r"(?U)[​‌‍⁠﻿­\s\x00-\x1f\x7f]"


def code_point_char(notation: Column) -> Column:
    """``U+3042`` to its character; anything that is not such a notation stays as it is."""
    hexa = F.substring(notation, 3, 16)
    valid = notation.rlike("^U\\+[0-9A-Fa-f]{2,6}$") & (F.conv(hexa, 16, 10).cast("long") <= 0x10FFFF) & ~hexa.rlike("^0*[dD][89a-fA-F][0-9a-fA-F]{2}$")
    return F.when(valid, F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")).otherwise(notation)


def code_point_char_anywhere(notation: Column) -> Column:
    """The reading without a check of the length: every ``U+`` goes, and what is left of a notation that begins with it is
    the code point; anything that is none stays as it is."""
    hexa = F.regexp_replace(notation, "U\\+", "")
    padded = F.concat(F.lit("U+"), F.when(F.length(hexa) < 2, F.lpad(hexa, 2, "0")).otherwise(hexa))
    read = code_point_char(padded)
    return F.when(notation.startswith("U+") & (F.length(hexa) > 0) & (read != padded), read).otherwise(notation)


def strip_white_space(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_SPACE, "")


def strip_invisible(text: Column) -> Column:
    """Without white space, control signs and signs of no width."""
    return F.regexp_replace(text, INVISIBLE, "")


def normalise_line(text: Column, drop_spaces: bool = False) -> Column:
    """No line ends, wide spaces as plain ones, trimmed; on request without any space."""
    flat = F.trim(F.replace(F.regexp_replace(text, "[\\r\\n]", ""), F.lit("　"), F.lit(" ")))
    return F.replace(flat, F.lit(" "), F.lit("")) if drop_spaces else flat


def characters(text: Column) -> Column:
    """Code points in order; none for the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def spaced(text: Column) -> Column:
    return F.array_join(characters(text), " ")


def reversed_text(text: Column) -> Column:
    """Reversed by tokens where there is a space, else by characters."""
    return F.when(F.contains(text, F.lit(" ")), F.array_join(F.reverse(F.split(text, " ")), " ")).otherwise(F.reverse(text))


def count_of(text: Column, target: str) -> Column:
    """How often ``target`` occurs, without overlaps."""
    rest = F.replace(text, F.lit(target), F.lit(""))
    return ((F.length(text) - F.length(rest)) / len(target)).cast("long")


def wrapped(text: Column, width: int = 80) -> Column:
    """Lines of ``width`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / width).cast("int") - 1))
    return F.array_join(F.transform(starts, lambda i: F.substring(text, i * width + 1, F.lit(width))), "\n")


def book_of(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(1))


def page_numbers(name: Column) -> tuple[Column, Column]:
    """Sequence and side of ``<book>_<sequence>_<side>``; null where the name has another form."""
    pattern = "^(\\d+)_(\\d+)_(\\d+)$"
    ok = name.rlike(pattern)
    return tuple(F.when(ok, F.regexp_extract(name, pattern, k).cast("long")) for k in (2, 3))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a name that begins with its only dot has none."""
    return F.regexp_replace(base_name(path), "(?<=.)\\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), "(?<=.)(\\.[^.]*)$", 1))


def natural_key(name: Column) -> Column:
    """Sorts as people do: digit runs by their value."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("\\d+|\\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\d"), F.lpad(F.regexp_replace(p, "^0+(?=\\d)", ""), 20, "0")).otherwise(p)), "")


def human_size(n: Column) -> Column:
    """Bytes with one decimal and the largest unit below which it stays under 1024."""
    out, size = F.format_string("%.1f YB", n / F.lit(float(1024**8))), n.cast("double")
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB"]))):
        out = F.when(F.abs(size) < float(1024 ** (k + 1)), F.format_string(f"%.1f {unit}", F.bround(size / float(1024**k), 1))).otherwise(out)
    return out


def candidates_label(top: Column, n: int = 3) -> Column:
    """``a(0.98), b(0.01)`` from the first candidates."""
    return F.array_join(F.transform(F.slice(top, 1, n), lambda t: F.format_string("%s(%.2f)", t["char"], t["prob"])), ", ")


def decoded(data: Column, invalid: str = "replace") -> Column:
    """UTF-8 text of bytes; invalid sequences become replacement marks, or go. Marks that the text itself has stay."""
    raw = data.cast("string")
    if invalid != "ignore":
        return F.make_valid_utf8(raw)
    # The text's own marks are spelt with two noncharacters meanwhile, so that what is left afterwards was invalid.
    mark, own, same, other = (F.lit(x) for x in ("\ufffd", "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2"))
    spelt = F.replace(F.replace(raw, own, other), mark, same)
    valid = F.replace(F.make_valid_utf8(spelt), mark, F.lit(""))
    return F.replace(F.replace(valid, same, mark), other, own)
