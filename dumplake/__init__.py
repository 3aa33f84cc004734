"""dumplake: bulk SQL-dump ingest and dump analytics as Spark jobs."""

__version__ = "0.1.0"
