"""kiln: DataFrame-in / DataFrame-out preparation, profiling, reporting,
statistics and modelling operators built on Spark's DataFrame, SQL and
Structured Streaming APIs.

Sub-packages:
  sources    readers and writers (CSV, delimited logs, JSON listings, files)
  functions  Column-level scalar expressions (strings, network, time, hashes)
  operators  DataFrame -> DataFrame operators (relational, profile, prep, ...)
  plans      composed reports and preparation chains over stand-in tables
  streaming  chunked / streaming ingestion and scoring
"""

__version__ = "0.1.0"
