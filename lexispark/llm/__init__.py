"""Operators of a training-data pipeline: decontamination, archives, chat assembly, toxicity, deduplication, search, packing, licences."""
