"""Model of the city-model engine."""
