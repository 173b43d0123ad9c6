"""Operators for building training corpora: output, archives, near copies, filters, mixing."""
