"""Operators of a training-data pipeline: quality rules, token counts, SimHash near-duplicates, language-model scores,
main text of pages, URL filters, licence scans, decontamination, substring dedup and piece segmentation."""
