"""Training-data operators: HTML extraction, fingerprints, quality, toxicity, packing,
mixing, line dedup, near-duplicates, WARC archives, URL filters, fill-in-the-middle, languages and prefix tries."""
