"""Part of textquarry: streaming."""
