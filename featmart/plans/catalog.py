"""The query catalogue: importing this module registers every query and oracle."""

from featmart.plans import (  # noqa: F401
    catalog_agg, catalog_core, catalog_encode, catalog_marts, catalog_model, catalog_scalar, catalog_select,
    catalog_seq,
)
from featmart.plans.registry import ORACLES, QUERIES, RAW  # noqa: F401
