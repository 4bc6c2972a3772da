"""Clinical report: one row per recording assembled from finished feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import cut_lineage
from .joins import assert_unique, prefixed

SECTIONS = ("staging", "respiratory", "oxygen", "spectral", "spindles", "rem_density", "hrv")


def assemble(base: DataFrame, sections: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join sections one to one onto the recordings; columns carry the section name.

    A section is written once, then checked for duplicate keys and joined from the written table.
    """
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown report sections {sorted(unknown)}; known: {SECTIONS}")
    out = base.select(*keys)
    for name in [s for s in SECTIONS if s in sections]:
        table = assert_unique(cut_lineage(sections[name]), keys, name)
        out = out.join(prefixed(table, name, keys), list(keys), "left")
    return out
