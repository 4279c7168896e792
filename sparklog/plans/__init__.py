"""The piped query language: text to syntax tree (language), tree to DataFrame (binder)."""
