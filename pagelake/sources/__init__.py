"""Readers and writers: parquet tables, manifests, asset trees, snapshots."""
