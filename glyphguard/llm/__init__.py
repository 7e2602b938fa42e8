"""Training-data operators: near-duplicate joins, decontamination, token counts, media columns,
packing, quality, line dedup, language ID, URL reputation and main-text extraction."""
