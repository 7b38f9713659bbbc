"""Part of textquarry: sinks."""
