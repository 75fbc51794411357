"""Text expressions shared by several operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ways of writing a DOI that name the same identifier: resolver addresses, a scheme word, blanks
#: and closing marks around it, letter case, an escaped slash.
DOI_PATTERN = r"^[\s\u00a0]*(?:https?://(?:www\.)?(?:dx\.)?doi\.org/|doi:\s*)?(10\.\d[\d.]*/\S*[^\s.,;:])[\s.,;:]*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doi(c: Column | str) -> Column:
    """The canonical form of a DOI, or null where the text holds none.

    One regular expression; use ``once`` where the result is used several times.
    """
    return F.try_element_at(F.regexp_extract_all(F.replace(F.lower(_col(c)), F.lit("%2f"), F.lit("/")), F.lit(DOI_PATTERN.replace("\\u00a0", "\u00a0")), F.lit(1)), F.lit(1))


def once(c: Column) -> Column:
    """``c`` as a generated column: its expression is evaluated once a row.

    The optimizer copies the expression of a plain column into every filter and projection above
    it; it doesn't look through a generator.
    """
    return F.explode(F.array(c))


def doi_registrant(canonical: Column) -> Column:
    """The part of a canonical DOI before the first slash."""
    return F.substring_index(canonical, "/", 1)


def doi_suffix(canonical: Column) -> Column:
    """The part of a canonical DOI after the first slash."""
    return F.substr(canonical, F.locate("/", canonical) + 1)


def strip(c: Column) -> Column:
    """Text without outer blanks of any kind."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
