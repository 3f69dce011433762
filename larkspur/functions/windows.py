"""Window-only functions by name; each gives a Column to put ``.over(window)`` on."""

from __future__ import annotations

from pyspark.sql import functions as F

FUNCTIONS = {
    "row_number": F.row_number,
    "rank": F.rank,
    "dense_rank": F.dense_rank,
    "percent_rank": F.percent_rank,
    "cume_dist": F.cume_dist,
    "ntile": F.ntile,
    "lag": F.lag,
    "lead": F.lead,
    "first_value": F.first_value,
    "last_value": F.last_value,
    "nth_value": F.nth_value,
}
