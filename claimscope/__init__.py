"""claimscope — provider-claims analytics as Spark DataFrame plans.

Layers:

* ``sources``   declared schemas, loaders, test-table mapping, warehouse build
* ``functions`` scalar expressions and aggregate measures
* ``operators`` filters, joins, facets, post-filters, reshaping
* ``plans``     reports, directory, KPIs, data preparation
* ``sinks``     CSV exports and materialised report tables
* ``streaming`` incremental publication of monthly files
"""

from claimscope.operators.filters import ClaimsFilter
from claimscope.sources.loaders import Tables

__all__ = ["ClaimsFilter", "Tables"]
