"""Query catalogue over the bundled tables."""
