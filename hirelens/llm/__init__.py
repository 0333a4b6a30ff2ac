"""Operators of a training-data pipeline: deduplication, tokens, quality, language models, extraction and packing.

Each operator is a function over a DataFrame with `doc_id` and `text` (pages: `page_id`, `url`, `html`). Other columns are
ignored, so clashing names cannot disturb it. NULL text counts as empty unless the operator says otherwise.
"""
