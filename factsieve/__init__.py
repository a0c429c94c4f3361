"""factsieve: batch table analytics as lazy Spark DataFrame operators."""
