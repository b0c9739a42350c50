"""Part of netloom; see README.md for the map of modules."""
