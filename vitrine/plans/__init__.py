"""plans of vitrine."""
