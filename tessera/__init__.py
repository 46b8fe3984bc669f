"""Sentence analytics on Spark: documents to sentences, features, filters, joins and statistics."""
