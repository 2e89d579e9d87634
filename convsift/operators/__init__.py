"""Search operators: keyword/regex, fuzzy, file trace, as-of lookup, reports."""
