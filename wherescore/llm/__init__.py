"""Operators that prepare training text: removal of copies, leaks and personal data, extraction, mixing, sharding."""
