"""URL scope, absolutising and canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(url: Column) -> Column:
    """Drop the fragment and the query string."""
    return F.regexp_replace(url, r"(?s)[#?].*$", "")


def site_base(url: Column) -> Column:
    """Scheme and host with a closing slash."""
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"))


def in_scope(href: Column, base: Column) -> Column:
    """Absolute canonical target of ``href`` below ``base``; NULL when out of scope."""
    rooted = F.startswith(href, F.lit("/")) & ~F.startswith(href, F.lit("//"))
    absolute = F.when(rooted, F.concat(F.rtrim(base, F.lit("/")), href)).when(
        F.startswith(href, base), href
    )
    return canonical(absolute)
