"""Corpus analytics on Spark: artifact index, retrieval, evidence graph and evaluation as DataFrame plans."""
