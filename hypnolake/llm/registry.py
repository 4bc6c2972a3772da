"""The corpus operators' queries and oracle texts."""

from . import alignment, bpe, chat, cws, hosts, licences, manifest, mixing, packing, pages, simhash, toxicity, urls  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
