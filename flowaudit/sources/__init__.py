"""Readers for flow tables and captures, and the explanation store."""
