import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loomlog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "loomlog-tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false", "spark.default.parallelism": "4",
            # Tiny inputs: interpreting is much faster than compiling. The checks on real tables use codegen.
            "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LOG = (
    "session_id STRING, event_group STRING, `order` BIGINT, visible_text STRING, message_time_text STRING, "
    "first_seen_at TIMESTAMP, is_marker BOOLEAN, marker_keyword STRING, sequence_hint_min BIGINT, "
    "canonical_record_id STRING, session_folder STRING, read_index BIGINT"
)
FIELDS = [f.split()[0].strip("`") for f in LOG.split(", ")]


@pytest.fixture(scope="session")
def make_log(spark):
    """A log from dicts; order defaults to the place in the list."""

    def make(*lines):
        rows = []
        for place, line in enumerate(lines):
            row = {
                "session_id": "s", "event_group": None, "order": place + 1, "is_marker": False,
                "canonical_record_id": f"r{place + 1}", "session_folder": "f", "read_index": place, **line,
            }
            rows.append(tuple(row.get(n) for n in FIELDS))
        return spark.createDataFrame(rows, LOG)

    return make


@pytest.fixture(scope="session")
def groups_log(make_log):
    """A log from groups of texts, one event group each."""

    def make(*groups):
        return make_log(*[
            {"event_group": f"g{n}", "visible_text": text} for n, texts in enumerate(groups) for text in texts
        ])

    return make


def rows(df, *columns):
    shown = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in shown.collect()), key=lambda r: [(x is None, str(x)) for x in r])
