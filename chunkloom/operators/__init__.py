"""Operators: routing, segmentation, symbols, enrichment, delivery."""
