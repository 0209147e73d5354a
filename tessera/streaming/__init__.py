"""Continuous refresh: landed pages or events as streams."""
