"""Viewer loads: the latest wins, the earlier one is cancelled."""

import time

import pytest
from pyspark.sql import functions as F

from quillon.plans.viewer import Backend, Viewer


@pytest.fixture
def viewer(spark):
    def slow(session, content, path):
        def nap(batches):
            for batch in batches:
                time.sleep(400)
                yield batch

        return session.range(4).mapInArrow(nap, "id long")

    quick = lambda session, content, path: session.range(len(content)).select("id", F.lit(path).alias("path"))
    bad = lambda session, content, path: session.range(1).select(F.raise_error(F.lit("broken cell")).alias("x"))
    takes = lambda mark: lambda content, path: content.startswith(mark)
    return Viewer(spark, [Backend("slow", ("s",), takes(b"S"), slow), Backend("quick", ("q",), takes(b"Q"), quick), Backend("bad", ("b",), takes(b"B"), bad)])


def test_a_second_load_cancels_the_first(spark, viewer):
    began = time.time()
    assert viewer.load(b"S", "a.s")
    first = viewer._thread
    time.sleep(2)
    assert viewer.load(b"Q12", "b.q") and viewer.wait(100)
    assert viewer.status == "loaded by quick" and viewer.scene.count() == 3 and viewer.error is None
    first.join(100)
    assert not first.is_alive() and time.time() - began < 300
    assert viewer.status == "loaded by quick" and viewer.scene.first()["path"] == "b.q"


def test_errors_and_unknown_formats_leave_the_scene(viewer):
    assert viewer.load(b"Q1", "x") and viewer.wait(100)
    assert not viewer.load(b"?", "y") and "not supported" in viewer.status
    assert viewer.load(b"B", "z") and viewer.wait(100)
    assert viewer.status == "error" and "broken cell" in viewer.error and viewer.scene.count() == 2
