"""functions of the asset-health library."""
