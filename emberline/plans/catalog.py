"""All registered queries."""

from emberline.plans import catalog_fuel, catalog_grid, catalog_landed, catalog_prep, catalog_weather  # noqa: F401
from emberline.plans.registry import CATALOG

__all__ = ["CATALOG"]
