"""codegauge: static code-quality analytics as Spark DataFrame transformations."""
