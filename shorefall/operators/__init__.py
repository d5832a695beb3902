"""Operators on cell tables: flood, resampling, zones, areas, priorities."""
