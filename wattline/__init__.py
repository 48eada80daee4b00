"""Grid, energy-community and text-corpus analytics as Spark DataFrame operators."""
