"""textquarry: searching, cleaning and exporting text at scale with Spark."""
