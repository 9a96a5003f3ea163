"""plans of the asset-health library."""
