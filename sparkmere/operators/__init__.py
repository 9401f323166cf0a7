"""DataFrame operators: pairs, overlap, lexical search, mining, assembly, dense search, fusion, metrics."""
