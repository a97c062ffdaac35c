"""folioworks: document intelligence over large tables, written as Spark DataFrame jobs."""
