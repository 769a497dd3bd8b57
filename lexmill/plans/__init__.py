"""Queries over the driver's tables; importing this registers them."""

from lexmill.plans import acceptance, building, citations, documents, events, evidence, hybrid, quality, records, resolution, retrieval, staleness, validation, workflow  # noqa: F401
