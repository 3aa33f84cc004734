"""Inputs: dump files, CSV exports, tables rendered as dumps, history logs; and the sinks."""
