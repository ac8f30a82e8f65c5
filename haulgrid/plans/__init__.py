"""Analytical queries, data products and their registration."""
