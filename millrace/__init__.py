"""millrace: context and corpus analytics as Spark DataFrame plans."""
