"""Spacecraft telemetry analytics as Spark jobs over tables and streams."""
