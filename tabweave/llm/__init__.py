"""Operators for preparing training corpora. Nothing else in tabweave imports this subpackage."""
