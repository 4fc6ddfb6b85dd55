"""All queries outside the optional subpackage: name -> (spark, sf_dir) -> DataFrame, and name -> SQL."""

import importlib

MODULES = ("batteries", "contexts", "duplicates", "identities", "images", "ledgers", "listings", "records", "reports", "statistics", "streams")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"assaya.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
