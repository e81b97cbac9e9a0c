"""Operators over DataFrames of images, patches, devices and sessions."""
