"""Part of textquarry: plans."""
