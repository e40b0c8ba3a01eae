"""Sources of the city-model engine."""
