"""Readers of the archive's inputs: CSV, JSON, Parquet, Turtle, EAD and segmentation files."""
