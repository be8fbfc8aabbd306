"""scribeloom: documentation work for large code bases, as Spark DataFrame jobs."""
