"""Sources and sinks: CSV cohort directories, clinical tables, driver test tables."""

from cohortlens.sources.csv import read_cohorts, read_clinical, parse_provenance, write_cohort_csv  # noqa: F401
from cohortlens.sources.sinks import write_table  # noqa: F401
from cohortlens.sources.testdata import (  # noqa: F401
    load_table, cohort, clinical, COHORT_FEATURES, COHORT_ORDER, FEATURES_WITH_HF,
)
