"""Coastal-inundation analytics on Spark: cell tables in, areas, exposure and priorities out."""
