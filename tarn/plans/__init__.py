"""The relational operators of the format's plans."""
