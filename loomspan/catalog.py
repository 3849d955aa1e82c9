"""All queries of the event-sequence library, by name, with their SQL."""

from __future__ import annotations

from loomspan.plans import alignment, annotations, audits, captions, catalogs, contracts, discovery, evaluation, exposure, hierarchy, intervals, jsontext, merging, metrics, noise, prompts, refs, scores, sequences, snapshots, splits, stateful, targets

_MODULES = (splits, intervals, sequences, merging, metrics, stateful, captions, hierarchy, contracts, evaluation, audits, exposure, alignment, jsontext, annotations, prompts, snapshots, targets, discovery, noise, scores, refs, catalogs)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: sql for m in _MODULES for k, sql in m.ORACLES.items()}
