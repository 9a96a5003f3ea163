"""sources of the asset-health library."""
