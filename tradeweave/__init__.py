"""tradeweave — bilateral trade-flow analytics as Spark DataFrame operators.

Layers: ``sources`` (readers, writers, stand-in inputs), ``functions``
(column expressions), ``operators`` (cleaning, star load, quality, queries),
``plans`` (end-to-end pipeline and the query registry), ``streaming``
(incremental landing).
"""

__version__ = "0.1.0"
