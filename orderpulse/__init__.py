"""orderpulse: retail-order analytics on Spark, in batch and as a stream.

Subpackages
-----------
functions   column expressions (strip, JSON paths, labels, display, time)
operators   DataFrame → DataFrame metrics, filters, paging, snapshots
sources     table, file and topic readers (batch and stream)
sinks       file, topic, table and snapshot writers
plans       the sales fact over the supplied tables and the named queries
streaming   the running category count, the snapshot loaders, the dashboard stream
jobs        runnable entry points (``python -m orderpulse.jobs --help``)
"""

__version__ = "0.1.0"
