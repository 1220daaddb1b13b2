"""Operational and event analytics as ordinary Spark DataFrame functions."""
