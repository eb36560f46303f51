"""Telemetry data quality on Spark: frame-lock, receiver levels and calibration as DataFrame operators."""
