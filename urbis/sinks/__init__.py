"""Sinks of the city-model engine."""
