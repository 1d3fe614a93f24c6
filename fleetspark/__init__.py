"""Spark analytics for operating a large fleet of client websites."""
