"""All registered queries: name -> (Spark callable, SQL twin or None)."""

from __future__ import annotations

from leafwork.catalog import corpora, configs, editing, following, reading, trees, writing

REGISTRY = {**corpora.QUERIES, **reading.QUERIES, **trees.QUERIES, **configs.QUERIES, **writing.QUERIES, **editing.QUERIES, **following.QUERIES}
