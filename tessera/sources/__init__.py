"""Readers: landed pages and their tables and links, JSON documents, sectioned sheets."""
