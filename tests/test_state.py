"""A state of findings under files that are added, edited, touched and deleted."""

import os

import pytest

from linewarden.plans.audit import static_audit
from linewarden.sources.files import sources_from_files
from linewarden.streaming import state as states


def rows(df):
    return sorted(map(tuple, df.select("path", "line", "category", "pattern").collect()))


def test_files_that_are_added_edited_and_deleted(spark, tmp_path):
    root, state = tmp_path / "code", str(tmp_path / "state")
    root.mkdir()
    for name, text in {"a.c": "gets(a);\n", ".b.c": "strcpy(a, b);\n" * 30, "c.rs": "x.unwrap();\n", "empty.cs": ""}.items():
        (root / name).write_text(text)

    def refresh():
        version = states.refresh_files(spark, state, str(root), range_bytes=100)
        now = rows(states.current_findings(spark, state))
        assert now == rows(static_audit(sources_from_files(spark, str(root))))
        change = states.changes(spark, state, version)
        return version, len(now), [(r["change"], os.path.basename(r["path"]), r["category"]) for r in change.collect()]

    with pytest.raises(ValueError, match="refresh it first"):
        states.current_findings(spark, state)
    version, n, changed = refresh()
    assert (version, n, len(changed)) == (1, 32, 32)
    (root / "a.c").write_text("system(a);\n")
    (root / "new.c").write_text("gets(b);\n")
    os.remove(root / "c.rs")
    os.utime(root / ".b.c", (1, 1))  # another time, the same content
    version, n, changed = refresh()
    assert version == 2 and n == 32
    assert sorted(changed) == [
        ("added", "a.c", "system-call"), ("added", "new.c", "gets"), ("retracted", "a.c", "gets"), ("retracted", "c.rs", "unwrap-in-code"),
    ]
    assert {os.path.basename(r["path"]): r["version"] for r in states.known_files(spark, state).collect()} == {
        "a.c": 2, ".b.c": 1, "empty.cs": 1, "new.c": 2,
    }
    assert rows(states.current_findings(spark, state, 1)) != rows(states.current_findings(spark, state))
    # A run that was lost before its files were written leaves the state as it was.
    os.remove(f"{state}/files/2/_SUCCESS")
    assert states.latest_version(spark, state) == 1
    version, n, changed = refresh()
    assert version == 2 and n == 32 and len(changed) == 4
