"""Paperline: invoice-line reconciliation and entity resolution as Spark DataFrame transformations."""
