"""Source analytics on PySpark: ranked name search, text search, relationships, histories."""
