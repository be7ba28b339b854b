"""Event-stream and sketch analytics as Spark plans."""

from rillmark.operators import bloom, bots, cache, frequency, prefix, priority, recommend, similarity, system, windows
from rillmark.sources import events, files, generator
from rillmark.streaming import jobs

__all__ = ["bloom", "bots", "cache", "events", "files", "frequency", "generator", "jobs", "prefix", "priority", "recommend", "similarity", "system", "windows"]
