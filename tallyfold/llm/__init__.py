"""Operators for preparing training text: quality, near copies, leaks, secrets, packing, archives."""
