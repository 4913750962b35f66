"""Operators for large training-data corpora, one module each.

Nothing outside this subpackage imports it; ``queries.py`` holds the
registered queries and ``corpus_pipeline.py`` at the top the pipeline."""

import importlib

from pyspark import cloudpickle

#: Modules whose functions run in Python workers: sent with each job by value,
#: so executors need no copy of this library.
for _name in ("token_counts", "bpe_codec", "circulant_minhash", "language_id", "html_crf",
              "cover_tree", "bloom_slices", "token_alignment", "warc_bundles"):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
