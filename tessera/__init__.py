"""Motif analytics over time series and corpora, as Spark jobs."""
