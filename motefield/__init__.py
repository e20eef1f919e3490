"""Sensor-packet analytics as DataFrame-to-DataFrame operators on Spark."""
