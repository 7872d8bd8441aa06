"""Training-data operators (language id, quality, dedup, extraction, packing ...).

Nothing else in the library imports this subpackage; `queries.py` lists its queries.
"""
