"""Schemas and what is compiled from them."""
