"""Writers: files, topics, tables, snapshots."""
