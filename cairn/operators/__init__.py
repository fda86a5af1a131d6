"""Relational and spatial operators."""
