"""operators of the tessera package."""
