"""Readers and writers: provider markup, captures, exports, attachments."""
