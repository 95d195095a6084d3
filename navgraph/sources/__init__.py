"""Reading source trees into fact tables."""
