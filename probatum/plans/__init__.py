"""The three flows: build the typed tables, validate a snapshot, compare two."""
