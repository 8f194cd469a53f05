"""fabula: analytics over grouped short narratives and their vectors, on PySpark."""
