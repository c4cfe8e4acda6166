"""Readers and writers: networks, rasters of values and codes, features."""

from thalweg.sources.files import load, read_ascii, read_nextxy, save, write_features

__all__ = ["load", "read_ascii", "read_nextxy", "save", "write_features"]
