"""docframe: a relational and document analytics engine on PySpark."""
