"""Scholarly evidence analytics on Spark."""
