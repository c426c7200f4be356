"""Reading and writing tables and snapshots."""
