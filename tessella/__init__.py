"""Tiled-geospatial analytics expressed as Spark DataFrame plans."""
