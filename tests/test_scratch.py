"""Letting go of what finished steps have left in the driver."""

from gristmill import scratch


def test_release_gives_native_memory_back(spark, monkeypatch):
    said, ask = [], scratch._diagnose
    monkeypatch.setattr(scratch, "_diagnose", lambda *a: said.append(ask(*a)))
    scratch.Scratch(spark, "released").release()
    assert len(said) == 1 and said[0].startswith("Trim native heap")
