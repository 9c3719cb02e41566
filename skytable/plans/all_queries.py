"""All registered queries, by importing the modules that hold them."""

import importlib

from skytable.plans.registry import ORACLES, QUERIES

MODULES = ("request_checks", "geometry_checks", "catalog_checks", "search_checks", "raster_checks", "feature_checks", "detection_checks", "instance_checks")

for _name in MODULES:
    importlib.import_module(f"skytable.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
