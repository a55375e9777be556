"""Imports every catalog module so their queries register."""

from kiln.plans import (  # noqa: F401
    cat_ml,
    cat_prep,
    cat_profile,
    cat_relational,
    cat_reports,
    cat_scalars,
    cat_sources,
    cat_stats,
)
