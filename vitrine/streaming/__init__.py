"""streaming of vitrine."""
