"""Readers and writers: text, partitioned parquet, Kafka, snapshots, event logs."""
