"""Specimen-trait analytics and corpus preparation as Spark jobs."""
