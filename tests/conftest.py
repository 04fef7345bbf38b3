from __future__ import annotations

import pytest

from riskframe.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", spark__driver__memory="6g")
    yield session
    session.stop()
