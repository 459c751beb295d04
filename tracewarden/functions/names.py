"""Column functions for names of catalog entities and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INNER = r"dataPlatform:([^,]+),([^,]+),"


def urn_name(urn: Column) -> Column:
    """The table or model in a urn, empty where it names none."""
    return F.regexp_extract(urn, _INNER, 2)


def urn_platform(urn: Column) -> Column:
    return F.regexp_extract(urn, _INNER, 1)


def entity_type(urn: Column) -> Column:
    """The kind of entity in upper case with underscores: mlModel becomes ML_MODEL."""
    return F.upper(F.regexp_replace(F.regexp_extract(urn, r"^urn:li:([A-Za-z]+):", 1), "([a-z])([A-Z])", "$1_$2"))


def flat(text: Column) -> Column:
    """White space of any kind and length as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def family(model: Column) -> Column:
    """A versioned model name without what follows its last underscore."""
    return F.regexp_replace(model, r"_[^_]*$", "")


def document_id(*parts: Column) -> Column:
    """Twelve hexadecimal digits of a digest of the parts."""
    return F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))
