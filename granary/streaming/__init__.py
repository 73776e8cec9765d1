"""Nothing: the dialect has no streams, windows over time or watermarks to re-express.

A database's tables are Parquet parts, so ``spark.readStream.schema(...).parquet(...)``
reads what is registered, and ``foreachBatch`` with ``Connection.execute`` of an INSERT ..
ON CONFLICT DO REPLACE makes a sink whose repeats do no harm.
"""
