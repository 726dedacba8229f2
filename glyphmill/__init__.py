"""Chinese-script text normalization and corpus analytics as Spark DataFrame plans."""
