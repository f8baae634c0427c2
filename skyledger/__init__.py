"""Airline performance analytics on Spark: flight facts, dimensions with history, marts, positions."""
