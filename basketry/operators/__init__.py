"""Reusable data operators."""
