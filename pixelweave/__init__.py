"""Raster, metadata and annotation analytics expressed as Spark DataFrames."""
