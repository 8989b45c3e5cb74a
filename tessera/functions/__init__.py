"""functions of the tessera package."""
