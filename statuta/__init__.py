"""Spark-native analytics for corpora of documents that amend a keyed body of sections."""
