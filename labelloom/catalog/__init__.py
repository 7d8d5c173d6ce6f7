"""The registered queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from labelloom.catalog import annotation, evaluation, features, models, storage, texts
from labelloom.catalog.entry import ENTRIES

__all__ = ["ENTRIES", "annotation", "evaluation", "features", "models", "storage", "texts"]
