"""Spark-native evaluation and governance of transcription datasets."""
