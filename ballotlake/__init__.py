"""Governance analytics as PySpark DataFrame operators."""

from ballotlake.functions.asof import EVERY, NOW, AsOf, block, unix
from ballotlake.model import GovTables

__all__ = ["EVERY", "NOW", "AsOf", "GovTables", "block", "unix"]
