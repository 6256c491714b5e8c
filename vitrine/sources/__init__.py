"""sources of vitrine."""
