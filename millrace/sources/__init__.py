"""Readers and writers of stage tables, manifests and run logs."""
