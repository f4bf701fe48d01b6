"""Reading and writing collections, snapshots, documents and side tables."""
