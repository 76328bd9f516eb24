"""Terrain, place and path analytics on PySpark."""
