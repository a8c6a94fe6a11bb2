"""Readers of probe documents, logs, captions and bytes, and the exports."""
