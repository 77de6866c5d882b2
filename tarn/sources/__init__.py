"""Reading the log: storage, listing and the schema of actions."""
