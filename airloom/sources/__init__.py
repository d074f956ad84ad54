"""Readers and writers: Parquet, CSV, landed JSON payloads, snapshots, keyed tables."""
