"""Dates of recordings and their side-cars; descriptions from CSV."""

import json
from datetime import date

import numpy as np

from wavefold.sources import edf, edf_source


def write(path, day):
    raw = edf_source.encode(["A"], [np.zeros(2)], 1, -1, 1)
    path.write_bytes(raw[:168] + day.encode() + raw[176:])


def test_dates_are_kept_beside_recordings(spark, tmp_path):
    write(tmp_path / "a.edf", "05.11.99")
    write(tmp_path / "b.edf", "31.01.04")
    write(tmp_path / "c.edf", "??.??.??")
    write(tmp_path / "d.edf", "01.01.01")
    (tmp_path / "d_date.txt").write_text('{"year": 2012, "month": 3, "day": 4}')
    got = lambda **k: {r.path.rsplit("/", 1)[1]: (r.date, r.source, r.kept) for r in edf.recording_dates(edf.discover(spark, str(tmp_path)), **k).collect()}
    first = {"a.edf": (date(1999, 11, 5), "header", False), "b.edf": (date(2004, 1, 31), "header", False), "c.edf": (None, "header", False), "d.edf": (date(2012, 3, 4), "side-car", True)}
    assert got(keep=False) == first and not (tmp_path / "a_date.txt").exists()
    assert {k: v[2] for k, v in got().items()} == {"a.edf": True, "b.edf": True, "c.edf": False, "d.edf": True}
    assert json.loads((tmp_path / "b_date.txt").read_text()) == {"year": 2004, "month": 1, "day": 31}
    assert {k: v[:2] for k, v in got().items()} == {k: (v[0], "side-car" if v[0] else "header") for k, v in first.items()}


def test_descriptions(spark, tmp_path):
    (tmp_path / "description.csv").write_text("path,subject,session,segment,year,month,day,epilepsy\np1,s2,1,0,2001,1,1,0\np2,s1,1,0,2001,1,1,1\np3,s2,2,0,2001,1,1,1\np4,,2,0,2001,1,1,1\n")
    d = edf.descriptions(spark, str(tmp_path))
    assert {r.path: (r.subject, r.epilepsy) for r in d.collect()} == {"p1": ("s2", 0), "p2": ("s1", 1), "p3": ("s2", 1), "p4": (None, 1)}
    assert {r.subject: r.epilepsy for r in edf.subject_labels(d).collect()} == {"s1": 1, "s2": 0}
