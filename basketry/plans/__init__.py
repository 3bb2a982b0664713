"""Declarative plans over the star."""
