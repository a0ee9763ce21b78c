"""Training-data operators over text corpora: one module for each operator, with shared array helpers."""
