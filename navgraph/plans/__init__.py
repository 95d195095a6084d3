"""The kernels applied to the star-schema tables, each with the same query in SQL."""
