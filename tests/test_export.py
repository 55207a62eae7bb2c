"""Every table of the cohort's export is read back and compared."""

import os

from wardlens.plans import catalog
from wardlens.sources import sinks

SF = os.environ.get("WARDLENS_TEST_SF", "/root/testdata/sf0.001")


def test_every_exported_table_has_a_query(spark, tmp_path):
    written = {os.path.basename(p) for p in sinks.dump_tables(catalog.cohort(spark, SF), str(tmp_path))}
    queries = {"labs": "dump_cohort", "encounters": "dump_cohort_encounters", "procedures": "dump_cohort_procedures"}
    assert written == {sinks.LAYOUTS["swan"][t] for t in queries}
    assert set(queries.values()) <= catalog.QUERIES.keys() & catalog.ORACLE.keys()
