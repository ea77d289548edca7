"""Chronoloom: industrial time-series analytics written as Spark DataFrame functions."""
