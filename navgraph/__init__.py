"""navgraph: code-fact analytics and corpus preparation on PySpark."""
