"""Spark jobs that build labelled text corpora and measure classifiers on them."""
