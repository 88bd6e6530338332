"""Ravelin: retrieval, answer-quality and corpus analytics expressed as Spark DataFrames."""
