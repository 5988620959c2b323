"""Canonical spellings of identifiers, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def canonical_accession(col: Column | str) -> Column:
    """Outer blanks removed, upper case, everything up to a colon and a final
    hyphen with digits (isoform) dropped; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.btrim(F.substring_index(F.upper(c), ":", -1), F.lit(BLANKS))
    return F.when(F.contains(c, F.lit("-")), F.regexp_replace(c, "-[0-9]+$", "")).otherwise(c)


def canonical_go(col: Column | str) -> Column:
    """Outer blanks removed, upper case, one colon between ``GO`` and the
    digits; other strings are only trimmed and upper-cased; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.btrim(F.upper(c), F.lit(BLANKS))
    return F.regexp_replace(c, "^GO[^0-9A-Z]*(?=[0-9]+$)", "GO:")


#: The same two rules as DuckDB SQL; ``{c}`` is the column.
ACCESSION_SQL = r"regexp_replace(trim(regexp_replace(upper({c}), '^.*:', ''), ' ' || chr(9) || chr(10) || chr(13)), '-[0-9]+$', '')"
GO_SQL = r"regexp_replace(trim(upper({c}), ' ' || chr(9) || chr(10) || chr(13)), '^GO[^0-9A-Z]*([0-9]+)$', 'GO:\1')"
