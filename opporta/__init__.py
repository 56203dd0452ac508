"""Spark jobs that turn collected web documents into scored sales opportunities."""
