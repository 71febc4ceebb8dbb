"""Spark jobs for retail menu listings, offer curation and visitor analytics."""
