"""Operators for building training corpora: filters, joins, classifiers, searches and mixing."""
