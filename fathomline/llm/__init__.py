"""Operators for preparing training text: deduplication, cleaning, models, packing, archives."""
