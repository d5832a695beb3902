"""Readers and writers of bands, scenarios, polygons, masks, tables and manifests."""
