import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from revline.session import get_session
    scratch = tempfile.mkdtemp(prefix="revline-tests-")
    os.environ.setdefault("REVLINE_SCRATCH", scratch)
    s = get_session(master="local[*]", shuffle_partitions=8, extra={"spark.local.dir": scratch})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="revline-t-")


def files_df(spark, rows):
    """rows: list of (repo_id, path, content)."""
    return spark.createDataFrame(rows, "repo_id string, path string, content string")


def findings_df(spark, rows):
    """rows: dicts with some finding fields; the rest are filled in."""
    from revline.operators.detectors import complete_findings
    cols = ["repo_id", "file", "line", "severity", "category", "title", "description", "auto_fixable",
            "stage", "stage_order", "seq"]
    data = [tuple(r.get(c) for c in cols) for r in rows]
    df = spark.createDataFrame(data, "repo_id string, file string, line int, severity string, category string, "
                                     "title string, description string, auto_fixable boolean, stage string, "
                                     "stage_order int, seq long")
    return complete_findings(df)
