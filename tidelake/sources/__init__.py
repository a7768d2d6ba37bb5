"""Readers of raw exchange and venue files into typed tables."""
