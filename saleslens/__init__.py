"""Retail star-schema analytics as lazy PySpark DataFrame transformations.

Layers, bottom to top:

* ``sources``   - table schemas, Parquet loaders, the mapping from the driver's tables, sinks
* ``functions`` - column expressions and row-level derived columns
* ``operators`` - ``DataFrame -> DataFrame`` joins, filters and aggregates
* ``plans``     - whole reports and the registered queries, composed from the layers below
"""
