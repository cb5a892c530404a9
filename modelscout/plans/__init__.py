"""Compositions: import, preparation, experiments, derived tables."""
