"""Accessibility analytics over large document collections, as Spark jobs."""
