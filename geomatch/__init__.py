"""Entity-resolution results over 3D city models, as PySpark DataFrame operators.

* :mod:`geomatch.functions` - column expressions (ids, labels, display text, colours, CRS)
* :mod:`geomatch.sources`   - scans and sinks (CityJSON, results, metrics, features, catalogue)
* :mod:`geomatch.operators` - lookups, matching, status, metrics, features, geometry, extraction
* :mod:`geomatch.plans`     - the registered queries and the adapters from the driver's tables
"""
