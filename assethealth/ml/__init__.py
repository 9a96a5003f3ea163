"""ml of the asset-health library."""
