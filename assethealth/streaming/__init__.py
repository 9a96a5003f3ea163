"""streaming of the asset-health library."""
