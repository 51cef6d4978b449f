"""Gristmill: analytics over tables and text, declared for Spark."""
