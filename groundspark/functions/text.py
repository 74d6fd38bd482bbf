"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, as patterns of Java know only ASCII's.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def collapse(text: Column) -> Column:
    """White space to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def fold(text: Column) -> Column:
    """Caseless form; sharp s becomes ss as in full case folding."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def phrase(text: Column) -> Column:
    """Folded text of a-z, 0-9 and single spaces: what phrases are matched on."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def contains_any(text: Column, markers: Iterable[str]) -> Column:
    """Whether any marker is in the lower-cased text, as a raw substring."""
    low = F.lower(text)
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(low, F.lit(m))
    return found


def capitalise_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def question(text: Column) -> Column:
    """Ends trimmed, one question mark; empty stays empty."""
    bare = F.regexp_replace(F.trim(text), r"[\s?.!]+$", "")
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("?")))


def section_title(title: Column) -> Column:
    """A section title in upper case without numbering, private glyphs and closing punctuation; empty becomes null."""
    bare = F.regexp_replace(collapse(title), r"^\d+(?:\.\d+)*\s+", "")
    bare = F.translate(bare, "\uf0b7\uf03c", "")  # private-use bullets
    bare = F.regexp_replace(bare, r"^[ \t\r\n:;?]+|[ \t\r\n:;?]+$", "")
    return F.nullif(F.upper(bare), F.lit(""))


def heading(path: Column) -> Column:
    return F.array_join(path, " > ")


def humanise(name: Column) -> Column:
    return F.initcap(F.translate(name, "_", " "))


#: Fixed value: the name space of URLs in RFC 9562.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, space: str = URL_SPACE) -> Column:
    """The name-based UUID (version 5) of a name in a name space: equal names have equal ids, wherever they are made."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def as_list(value: Column) -> Column:
    """A JSON array of strings as an array; any other text as an array of itself; null and empty as none."""
    none = F.array().cast("array<string>")
    found = F.when(F.startswith(F.trim(value), F.lit("[")), F.from_json(value, "array<string>"))
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", none).otherwise(F.coalesce(found, F.array(value)))
