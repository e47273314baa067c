"""Ticket analytics as Spark jobs: similarity search, clustering, metrics and message routing."""
