"""Durable calls: a rerun after a failed group asks only what has no answer."""

import os
import uuid

import pytest

from themeloom.operators import ledger as L
from themeloom.operators.storage import shared_folder


def test_rerun_pays_at_most_one_group(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    ledger = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    rows = [(i, f"prompt {i % 150}") for i in range(300)] + [(999, None)]
    requests = spark.createDataFrame(rows, "id int, prompt string")
    dead = tmp_path / "dead"

    def respond(prompt):
        (calls / uuid.uuid4().hex).write_text(prompt)
        if prompt == "prompt 77" and not dead.exists():
            dead.write_text("once")
            raise SystemExit("the task dies")  # not caught by the call wrapper: the job fails
        return prompt.upper()

    with pytest.raises(Exception):
        L.complete_durably(requests, respond, ledger, group_rows=40, concurrency=1)
    first = len(os.listdir(calls))
    got = L.complete_durably(requests, respond, ledger, group_rows=40, concurrency=2).collect()
    asked = [p.read_text() for p in calls.iterdir()]
    assert len(got) == 301
    assert all(r["response"] == r["prompt"].upper() for r in got if r["prompt"])
    assert [r["response"] for r in got if r["prompt"] is None] == [None]
    # each of 150 distinct prompts paid once, plus at most the group that failed
    assert 150 <= len(asked) <= 150 + 40 and first < len(asked)
    before = len(asked)
    L.complete_durably(requests, respond, ledger, group_rows=40).count()
    assert len(os.listdir(calls)) == before  # nothing asked again
