"""Coupon-campaign A/B analytics on Spark.

Layers:

* ``sources``   – readers and writers for the raw, silver and gold layers, plus the
  mapping of the generic test tables onto the order model (``testviews``).
* ``functions`` – column expressions (parsing, exact money sums, segment labels).
* ``operators`` – ``DataFrame -> DataFrame`` building blocks: typing, joins, KPIs,
  viability, segments, customer profiles and data-quality checks.
* ``plans``     – the named queries and their independent SQL oracles.
* ``streaming`` – the ingest and ABT layers as incremental Structured Streaming jobs.
* ``llm``       – operators of a training-data pipeline; nothing else imports them.

No operator collects rows to the driver.  Results are DataFrames still to be run; where a
bounded statistic decides the plan (sizes of dimensions, A/B labels, hot keys, models), a
job for it runs while the DataFrame is built.
"""
