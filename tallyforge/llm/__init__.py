"""Training-data operators: secrets, near-duplicates, language, toxicity, neighbours, decontamination,
language-model scoring, WARC, packing and sharding. Nothing outside this subpackage imports it."""
