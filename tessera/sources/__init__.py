"""sources of the tessera package."""
