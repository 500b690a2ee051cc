"""The rule catalogue as data: what to detect, for which dialects, how severe."""
