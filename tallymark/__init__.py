"""Tallymark: agreement checks between data sets, written as Spark DataFrame plans."""
