"""Part of textquarry: operators."""
