"""Raster, elevation and climatology analytics as Spark DataFrame operators."""
