"""Operators for large training-data pipelines: WARC archives, quality rules,
substring and near-duplicate removal, URL filters, mixing, language-model
filtering, token counts and SentencePiece sampling."""
