"""Operators that also run on a streaming DataFrame as they are.

The reference data has no event time and no operator keeps state over time, so nothing
is added here. These operators are row-local projections and filters, which Structured
Streaming runs without a watermark or state:

* :func:`revlens.operators.security.scan_code`
* :func:`revlens.operators.features.sample_features` (without a structure table)
* :func:`revlens.operators.reuse.with_shingles`
* :func:`revlens.operators.gates.evidence_quality`
* the filters of :mod:`revlens.operators.validation`, except ``duplicates`` and
  ``foreign_target``

``tests/test_streaming.py`` runs them from a file source.
"""
