"""Scalar and per-image functions: container layouts, statuses, sizing, codecs, delta coding, cryptography."""
