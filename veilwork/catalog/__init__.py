"""All named queries."""

from veilwork.catalog import detection, io, numbering, quality, rules, surrogates, text  # noqa: F401
from veilwork.catalog.base import QUERIES, SQL as ORACLE

__all__ = ["QUERIES", "ORACLE"]
