"""Scalar functions by name, PostgreSQL semantics unless a MySQL name says otherwise.

``FUNCTIONS[name]`` takes Columns (or Python values) and gives a Column.
Functions are expressions of Spark's own wherever those can say it; the rest
are Arrow-batched Python functions, pickled by value so that executors need
not have this package.
"""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

from . import arrays, casts, conditional, dates, digests, geometry, json_docs, maths, network, ranges, session_info, strings, textsearch, trigrams, windows, xml_docs  # noqa: E402

FAMILIES = {
    "strings": strings.FUNCTIONS,
    "maths": maths.FUNCTIONS,
    "conditional": conditional.FUNCTIONS,
    "dates": dates.FUNCTIONS,
    "arrays": arrays.FUNCTIONS,
    "json": json_docs.FUNCTIONS,
    "digests": digests.FUNCTIONS,
    "textsearch": textsearch.FUNCTIONS,
    "trigrams": trigrams.FUNCTIONS,
    "ranges": ranges.FUNCTIONS,
    "network": network.FUNCTIONS,
    "geometry": geometry.FUNCTIONS,
    "xml": xml_docs.FUNCTIONS,
    "casts": casts.FUNCTIONS,
    "session": session_info.FUNCTIONS,
    "windows": windows.FUNCTIONS,
}
FUNCTIONS = {name: f for family in FAMILIES.values() for name, f in family.items()}
