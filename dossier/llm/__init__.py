"""Operators that prepare text for training: near copies, quality, language, packing, mixing."""
