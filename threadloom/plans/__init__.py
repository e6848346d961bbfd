"""Whole jobs: a mailbox thread from markup to result, export, capture and replay."""
