"""A double-entry ledger of value fragments, as DataFrame to DataFrame functions."""
