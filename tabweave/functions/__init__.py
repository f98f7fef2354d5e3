"""Subpackage of tabweave."""
