"""Event and announcement records from tables of landed web pages."""

from eventmill.operators.extractors import Layout, register_extractor
from eventmill.plans.publish import publish, upcoming
from eventmill.plans.scrape import extract, failures, scrape
from eventmill.schema import RECORD_FIELDS, RECORD_SCHEMA, Options
from eventmill.sources.pages import read_pages
from eventmill.sources.registry import read_registry, select_sources, validate_registry

__all__ = [
    "Layout",
    "Options",
    "RECORD_FIELDS",
    "RECORD_SCHEMA",
    "extract",
    "failures",
    "publish",
    "read_pages",
    "read_registry",
    "register_extractor",
    "scrape",
    "select_sources",
    "upcoming",
    "validate_registry",
]
