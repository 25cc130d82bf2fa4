"""Part of corvine; see the README for the map of modules."""
