"""Verification of form data at scale, as DataFrame and SQL plans."""
