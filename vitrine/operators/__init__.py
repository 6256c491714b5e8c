"""operators of vitrine."""
