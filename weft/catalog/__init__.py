"""Queries over the driver tables, a module for each part of the engine."""
