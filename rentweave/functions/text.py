"""Regular-expression dialect and text helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentweave.functions.numbers import SPACE_CLASS

_WORD = "[A-Za-z0-9_]"
_ASCII_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def dialect(pattern: str, ignore_case: bool = True) -> str:
    r"""Portal patterns assume ASCII ``\b``/``\w``, Unicode ``\s`` and full case folding; say so to Java."""
    out = pattern.replace(r"\b", _ASCII_BOUNDARY)
    out = out.replace(r"[\s\S]", r"(?s:.)").replace(r"[-\s]", "[-" + SPACE_CLASS[1:])
    out = out.replace(r"[^\s", "[^" + SPACE_CLASS[1:-1]).replace(r"’\s]", "’" + SPACE_CLASS[1:])
    out = out.replace(r"\s+", SPACE_CLASS + "+").replace(r"\s*", SPACE_CLASS + "*").replace(r"\s?", SPACE_CLASS + "?")
    return ("(?iu)" if ignore_case else "") + out


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def normalize_address(address: Column) -> Column:
    return F.lower(F.regexp_replace(trim_space(address), rf"{SPACE_CLASS}+", " "))


# Latin letters with diacritics and the base letter left once the marks are stripped.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĖėĘęĚěĞğĪīĹĺĽľŃńŇňŌōŐőŔŕŘřŚśŞşŠšŢţŤťŪūŮůŰűŹźŻżŽž"
UNACCENTED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeEeGgIiLlLlNnNnOoOoRrRrSsSsSsTtTtUuUuUuZzZzZz"


def strip_accents(text: Column) -> Column:
    """Base letters of accented Latin text; combining marks already split off are dropped."""
    return F.regexp_replace(F.translate(text, ACCENTED, UNACCENTED), r"\p{M}", "")


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip_accents(text)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# Named entities in the order they are replaced.
NAMED_ENTITIES = [("&amp;", "&"), ("&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")]


def _character(code: Column, digits: Column) -> Column:
    """The character of a code point; text of one beyond Unicode, and U+FFFD for half a surrogate pair."""
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(code.isNull() | (code > 0x10FFFF), F.concat(F.lit("&#"), digits, F.lit(";")))
        .when(code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .otherwise(wide)
    )


def _code_points(text: Column, entity: str, base: int) -> Column:
    """Replace each match of ``entity`` (group 1: its digits) by its character: the texts between the matches, each followed by one."""
    between, digits = F.split(text, entity), F.regexp_extract_all(text, F.lit(entity), F.lit(1))
    # More than 16 digits without leading zeros never fit; `conv` would only saturate.
    code = lambda d: F.conv(d, base, 10).try_cast("bigint")
    ends = F.transform(digits, lambda d: _character(code(d), d))
    return F.array_join(F.zip_with(between, ends, lambda t, c: F.concat(t, F.coalesce(c, F.lit("")))), "")


def html_entity_decode(text: Column) -> Column:
    """Hex, then decimal, then five named entities; only texts that hold a numeric one are taken apart."""
    hexa = F.when(text.contains("&#x") | text.contains("&#X"), _code_points(text, "&#[xX]([0-9a-fA-F]+);", 16)).otherwise(text)
    numeric = F.when(hexa.contains("&#"), _code_points(hexa, "&#([0-9]+);", 10)).otherwise(hexa)
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), NAMED_ENTITIES, numeric)
