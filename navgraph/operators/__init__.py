"""Relational kernels: column names are parameters, so they serve code facts and any other tables."""
