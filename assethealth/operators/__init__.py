"""operators of the asset-health library."""
