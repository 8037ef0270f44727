"""Provenance and evidence analytics as Spark DataFrame programs."""
