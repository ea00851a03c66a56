"""Operators that prepare corpora for training and retrieval. Nothing outside this subpackage imports it."""
