"""Readers: landed API pages (JSON), scraped HTML lists, CSV tables with declared schemas."""
