"""plans of the tessera package."""
