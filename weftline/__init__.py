"""Weftline: extraction, verification and scoring of crawled event pages as Spark DataFrame transformations."""
