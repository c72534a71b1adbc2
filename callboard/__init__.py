"""Production reporting, data quality and change tracking on Spark DataFrames.

Sub-packages:

``sources``    declared schemas, loading, views, append and snapshot sinks
``functions``  scalar column expressions and SQL functions
``operators``  lookups, joins, aggregates, validation rules, row changes
``plans``      named reports and the registry of runnable queries
``streaming``  jobs over unbounded input with the same results as their batch form
"""
