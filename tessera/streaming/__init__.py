"""streaming of the tessera package."""
