"""Streaming forms of some operators; an extension, as the batch operators need no stream."""
