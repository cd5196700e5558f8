"""Assembled batch plans and the registered query catalogue."""
