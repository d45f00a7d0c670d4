"""Catalogue of registered queries with their SQL."""
