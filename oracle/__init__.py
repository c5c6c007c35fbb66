"""Independent SQL checks, one per query that SQL can express."""

from oracle import scalars, search, sources, streams, tables  # noqa: F401
from oracle.registry import ORACLES

__all__ = ["ORACLES"]
