"""All registered queries; importing the modules fills the registry."""

from fairlead.catalog import cleaning, collisions, delivery, priority, search  # noqa: F401
from fairlead.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
