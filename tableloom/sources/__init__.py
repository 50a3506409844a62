"""Readers, sinks and the dataset catalog."""
