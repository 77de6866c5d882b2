"""Writing, change feeds and maintenance."""
