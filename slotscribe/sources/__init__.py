"""Inputs: block tables and streams, and interface descriptions."""
