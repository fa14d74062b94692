"""Readers: bytes and markup to rows."""
