"""Annotation analytics on Spark: votes, routing, calibration, evaluation and reshaping as DataFrame pipelines."""
