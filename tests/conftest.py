from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from eventlens.session import get_session, ship_package

    s = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
    )
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frames(spark):
    from registry.frames import Frames

    return Frames(spark, SAMPLE)
