"""Part of textquarry: sources."""
