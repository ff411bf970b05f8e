"""Operators for preparing training text: dedup, language, licences, quality, pages, mixing and packing."""
