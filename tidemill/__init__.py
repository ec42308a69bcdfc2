"""tidemill: content, traffic and recommendation analytics as PySpark DataFrame operators."""
