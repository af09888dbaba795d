"""colloquy: conversation analytics and corpus preparation on PySpark."""
