"""Column functions on text, time, identity and markup."""
