"""Scalar and table-valued functions on texts, dates, paths and codecs."""
