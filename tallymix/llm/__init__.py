"""Preparation of training text: deduplication, packing, filtering, mixing and token files.

Every operator takes a DataFrame with a ``doc_id`` and the columns it names, ignores all other columns and
returns a new frame. Nothing else in the package imports this folder.
"""
