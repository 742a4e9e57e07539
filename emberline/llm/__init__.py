"""Operators for training-data pipelines: token files, packing, archives, secret
scans, similarity joins, language-model scoring, media columns, quality scores,
exact vector search, piece encoding, hard negatives, centroids and token counts.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
