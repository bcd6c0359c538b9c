"""roofline: listing monitoring as Spark DataFrame operators.

Sub-packages: ``functions`` (Column expressions), ``sources`` (scans and
extraction), ``operators`` (joins, dedup, enrichment, delivery, run-log
analytics), ``streaming`` (the cycle as a Structured Streaming query) and
``plans`` (test-data adapters and the registered queries).
"""

__version__ = "0.1.0"
