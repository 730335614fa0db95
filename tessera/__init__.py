"""Tessera: a tensor and corpus analytics engine made of ordinary Spark DataFrames."""
