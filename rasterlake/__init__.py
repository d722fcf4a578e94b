"""Raster tile pyramids, tile catalogues and job streams as Spark DataFrames."""
