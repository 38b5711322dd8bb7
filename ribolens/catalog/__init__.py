"""All registered queries of the motif engine, with their SQL."""

from __future__ import annotations

from ribolens.catalog import alignments, candidates, discovery, folding, formats, intervals, kernels, measures, motifs, relations, sequences, structures

FLAGSHIP = "alignment_summary"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (sequences, alignments, intervals, candidates, motifs, kernels, formats, structures, relations, measures, folding, discovery):
    for _name, (_run, _sql) in _module.ENTRIES.items():
        QUERIES[_name] = _run
        if _sql:
            ORACLE_SQL[_name] = _sql
