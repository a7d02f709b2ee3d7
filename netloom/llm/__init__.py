"""Operators for preparing training text and media at corpus scale."""
