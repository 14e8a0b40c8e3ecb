"""Readers of message logs and landed request files."""
