"""DataFrame operators: dated lookup, search, cases, graph construction and retrieval."""
