"""DataFrame operators: profiling, preparation, measurement tables, metrics, documents."""
