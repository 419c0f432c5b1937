"""License notices as they stand in real files."""

import textwrap

import pytest
from test_operators import make

from quillscope.llm.license_scan import TEMPLATES, scan_licenses


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices(spark, mark):
    rows, due = [], []
    for k, (name, wording) in enumerate(sorted(TEMPLATES.items())):
        lines = [mark + x for x in textwrap.wrap(wording, 72)]
        if len(lines) > 1:
            lines.insert(1, mark)  # a blank line inside
        rows.append([k, "\n".join(["plain words", "", *lines, "", "under more plain words"]), "s"])
        due.append((k, 2, name, True, 0, "\n".join(lines)))
    assert sorted((r.doc_id, r.line, r.license, r.exact, r.missing, r.block) for r in scan_licenses(make(spark, rows)).collect()) == due


def test_every_notice_of_a_line(spark):
    legal = "The parties agree that the software and the documentation are provided to the licensee under the terms of this license, without warranties of any kind, and that copies of the work may be made in compliance with the conditions stated above, unless otherwise agreed in writing by the author. "
    rows, due = [], []
    for k, (name, wording) in enumerate(sorted(TEMPLATES.items())):
        rows.append([k, legal * 2 + wording + " " + legal * 2, "s"])
        due.append((k, 0, name))
    mit, apache, sa = TEMPLATES["mit"], TEMPLATES["apache-2.0"], "Licensed under CC BY 4.0 and CC BY-SA 4.0."
    rows += [[100, f"{apache} {legal}{mit} {mit}", "s"], [101, sa, "s"]]
    due += [(100, 0, "apache-2.0"), (100, 0, "mit"), (100, 0, "mit"), (101, 0, "cc-by-4.0"), (101, 0, "cc-by-sa-4.0")]
    assert sorted((r.doc_id, r.line, r.license) for r in scan_licenses(make(spark, rows)).collect()) == due


GROUPS = [("bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "bsd-opening"), ("mit-full", "mit-text", "mit-0", "x11"), ("isc", "0bsd"), ("gpl-2.0-header", "gpl-3.0-header", "lgpl-2.1-header", "lgpl-3.0-header", "agpl-3.0-header"), ("cc-by-4.0", "cc-by-nd-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0")]


def test_neighbours_are_told_apart(spark):
    rows, due = [], []
    for name in (name for group in GROUPS for name in group):
        wording = TEMPLATES[name].split()
        lacking = wording[:9] + wording[10:]  # a changed wording is still nearest to its own
        rows += [[2 * len(due), " ".join(wording), "s"], [2 * len(due) + 1, " ".join(lacking) if len(wording) > 60 else "", "s"]]
        due.append((name, True, 0))
    got = {}
    for r in scan_licenses(make(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.exact, r.missing))
    assert [got[2 * k] for k in range(len(due))] == [[x] for x in due]
    assert all(x[0][:2] == (due[k // 2][0], False) and len(x) == 1 for k, x in got.items() if k % 2)


def test_differences(spark):
    words = TEMPLATES["mit-full"].split()
    changed = [*words[:5], "costless", *words[6:20], "foo", *words[20:30], *words[31:]]
    r = scan_licenses(make(spark, [[1, " ".join(changed), "s"]])).first()
    got = [(d.kind, d.template, d.found) for d in r.differences]
    assert r.license == "mit-full" and not r.exact and r.missing == 2
    assert got == [("replaced", "of", "costless"), ("inserted", "", "foo"), ("missing", words[30].strip('(",").').lower(), "")]
    assert all(r.differences == [] for r in scan_licenses(make(spark, [[1, TEMPLATES["isc"], "s"], [None, TEMPLATES["isc"], None]])).collect())
