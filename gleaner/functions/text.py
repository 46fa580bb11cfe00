"""String and path expressions, all built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85"
    "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def decode_utf8(content: Column) -> Column:
    """Bytes to text, each malformed sequence becoming U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Extension with its dot; empty when the last dot opens or closes the name."""
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def language_tag(path: Column, fallback: str | None = None) -> Column:
    """Extension without its dot, ``fallback`` when there is none."""
    tag = F.regexp_replace(suffix(path), r"^\.", "")
    return tag if fallback is None else F.coalesce(F.nullif(tag, F.lit("")), F.lit(fallback))


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def relative_path(path: Column, root: Column) -> Column:
    """Path below ``root``, always with forward slashes."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.substr(unix, F.length(base) + 2)


def source_key(name: Column) -> Column:
    """A source name usable as one path segment."""
    return F.replace(name, F.lit("/"), F.lit("__"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
