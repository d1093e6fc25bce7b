"""Operators of a training-data pipeline: dedup, decontamination, packing, quality, URLs, licences, token files."""
