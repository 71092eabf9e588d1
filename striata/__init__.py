"""A Spark-native toolkit for reading, decoding and inspecting columnar files."""
