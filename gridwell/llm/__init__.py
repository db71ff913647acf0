"""Operations of a training-data pipeline: search, packing, deduplication,
scans, scoring, decontamination, filters and token files.

Nothing outside this subpackage and ``corpus_pipeline`` imports it.
"""
