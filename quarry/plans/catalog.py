"""All registered queries and their SQL."""

from __future__ import annotations

from . import claims, evidence, identities, ingest, retrieve, rules, search

QUERIES = {**search.QUERIES, **evidence.QUERIES, **rules.QUERIES, **claims.QUERIES, **ingest.QUERIES, **identities.QUERIES, **retrieve.QUERIES}
SQL = {**search.SQL, **evidence.SQL, **rules.SQL, **claims.SQL, **ingest.SQL, **identities.SQL, **retrieve.SQL}
