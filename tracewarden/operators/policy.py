"""Policy packs: which attributes a regime restricts, on what basis, and which of them can be tested."""

from __future__ import annotations

import os
from functools import cache
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dimension

FOLDER = Path(__file__).resolve().parent.parent / "policy"
#: Bases in order of severity; a finding that rests on another sorts last.
BASES = ("prohibited", "conditional", "examine")
DEFAULT = "ecoa"


@cache
def declared() -> dict[str, dict]:
    return yaml.safe_load((FOLDER / "attributes.yml").read_text())


@cache
def packs() -> dict[str, dict]:
    return yaml.safe_load((FOLDER / "packs.yml").read_text())


def available() -> list[str]:
    """The regimes that have a pack, by name."""
    return sorted(packs())


def pack(regime: str | None = None) -> dict:
    """The named pack; without a name, the one in TRACEWARDEN_REGIME or else DEFAULT. An unknown name raises KeyError."""
    regime = regime or os.environ.get("TRACEWARDEN_REGIME", DEFAULT)
    if regime not in packs():
        raise KeyError(f"no pack {regime!r}; there are {', '.join(available())}")
    return packs()[regime]


def attributes(spark: SparkSession) -> DataFrame:
    rows = [(a, d["column"], d["kind"], None if d.get("reference") is None else str(d["reference"]), len(d.get("categories") or {})) for a, d in declared().items()]
    return dimension(spark, rows, "attribute string, column string, kind string, reference string, n_codes int")


def encodings(spark: SparkSession) -> DataFrame:
    """What the declaration says of an attribute's coding, and what else it stands for."""
    return dimension(spark, [(a, d.get("encoding"), d.get("proxy_for")) for a, d in declared().items()], "attribute string, encoding string, proxy_for string")


def codes(spark: SparkSession) -> DataFrame:
    rows = [(a, str(c), label) for a, d in declared().items() for c, label in (d.get("categories") or {}).items()]
    return dimension(spark, rows, "attribute string, code string, label string")


def restricted(spark: SparkSession) -> DataFrame:
    rows = [(r, a, x.get("basis"), x.get("citation"), p["citation"]) for r, p in packs().items() for a, x in p["restricted"].items()]
    return dimension(spark, rows, "regime string, attribute string, basis string, citation string, regime_citation string")


def protected_tags(spark: SparkSession) -> DataFrame:
    return dimension(spark, [(r, t) for r, p in packs().items() for t in p["protected_tags"]], "regime string, tag string")


def resolved(spark: SparkSession) -> DataFrame:
    """Every regime's attributes with what they inherit: basis prohibited and the regime's citation unless stated. Attributes that nobody declares are left out."""
    out = restricted(spark).join(attributes(spark), "attribute")
    basis, citation = F.coalesce("basis", F.lit(BASES[0])), F.coalesce("citation", "regime_citation")
    return out.select("regime", "attribute", "column", "kind", "reference", "n_codes", basis.alias("basis"), citation.alias("citation"))


def untestable(spark: SparkSession) -> DataFrame:
    """Restricted attributes that cannot be measured, and why."""
    why = F.when(F.col("kind") == "continuous", "continuous").when(F.col("n_codes") == 0, "no coding").when(F.col("reference").isNull(), "no reference")
    return resolved(spark).withColumn("why", why).filter("why IS NOT NULL").select("regime", "attribute", "why")


def by_column(spark: SparkSession) -> DataFrame:
    """(regime, column, attribute, basis, citation) for every regime; a column that a regime does not restrict has no row."""
    return resolved(spark).select("regime", "column", "attribute", "basis", "citation")


def basis_rank(basis):
    """0 for the gravest basis, 9 for none of them."""
    out = F.when(basis == BASES[0], 0)
    for i, b in enumerate(BASES[1:], 1):
        out = out.when(basis == b, i)
    return out.otherwise(9)
