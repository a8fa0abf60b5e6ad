"""Readers, and the bars and macro tables built from them."""
