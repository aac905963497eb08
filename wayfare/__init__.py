"""Trip, stream, flight-network and flight-quality analytics as Spark DataFrame functions."""
