"""Conversation analytics on PySpark: split, reconcile, order, identify, search, mask, capture and maintain message threads."""
