"""hookline: phishing-email scoring as Spark DataFrame jobs.

Sub-packages:
  sources    readers (parquet tables, CSV corpora), fixture views, sinks
  functions  Column-level building blocks (text cleaning, URL features, labels)
  operators  DataFrame -> DataFrame jobs (aggregates, ranks, ROC, folds, models)
  plans      compositions: cross-validation, scoring, the query catalog
  streaming  Structured Streaming form of the scoring path
"""

__all__ = ["session"]
