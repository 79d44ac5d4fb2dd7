"""Telemetry and inventory analytics on Spark DataFrames: labelled samples, log lines, probes, alerts, configuration."""
