from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tokenledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture
def event():
    """A valid event as JSON text, with changes; a value of ``...`` removes the key."""

    def make(**changes) -> str:
        base = {
            "request_id": "00000000-0000-4000-8000-000000000001",
            "service": "answer-desk",
            "provider": "openai",
            "model": "gpt-4o-mini",
            "status": "success",
            "streamed": True,
            "started_at": "2025-03-09T07:30:00Z",
            "completed_at": "2025-03-09T07:30:02Z",
            "latency_ms": 1740,
            "ttft_ms": 310,
            "prompt_tokens": 61,
            "completion_tokens": 27,
            "total_tokens": 88,
            "client_metadata": {"desk": "north"},
        }
        base.update(changes)
        return json.dumps({k: v for k, v in base.items() if v is not ...})

    return make
