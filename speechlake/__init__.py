"""Spark jobs for curating speech corpora and judging the systems trained on them."""
