"""ferrule: Spark-native data preparation and evaluation for small language models.

Every public function takes and returns ``DataFrame``s (or column expressions)
and never collects data to the driver. Sub-packages:

* ``functions`` - column expressions (tokens, text cleanup, arrays, colours)
* ``sources``   - table readers, metric CSV readers, manifests
* ``sinks``     - CSV/Parquet writers with publish-last manifests
* ``operators`` - chunking, splitting, scoring, preference, router analytics
* ``plans``     - derived fixtures and the registered query catalogue
* ``streaming`` - Structured Streaming forms of the metric and chunk operators
"""

__version__ = "0.1.0"
