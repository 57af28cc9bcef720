from __future__ import annotations

import pytest

from quillspark.sources import workspace as W


def test_paths_on_disk(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("x" * 10)
    (tmp_path / "b.md").write_text("b")
    assert W.copy(str(tmp_path), "a/x.md", str(tmp_path / "out"), "y/x.md") == 10 and (tmp_path / "out/y/x.md").read_text() == "x" * 10
    with pytest.raises(FileExistsError):
        W.copy(str(tmp_path), "a/x.md", str(tmp_path / "out"), "y/x.md")
    assert W.clear(str(tmp_path), ["a", "b.md", "none", ".", "../x", "/etc"]) == ["a", "b.md"] and not (tmp_path / "a").exists()
    naps = []
    W.wait_for(str(tmp_path), ["new.md"], sleep=lambda s: naps.append(s) or (tmp_path / "new.md").write_text("x"))
    assert naps == [5]
    with pytest.raises(TimeoutError):
        W.wait_for(str(tmp_path), ["never.md"], poll=0, most=0)
    with pytest.raises(ValueError):
        W.wait_for(str(tmp_path), ["../x"])


def test_templates():
    text = "always\n[deep] only deep {n}\n[a][b] either\nlast"
    assert W.template(text, deep=True, n=3) == "always\nonly deep 3\nlast"
    assert W.template(text, b=True, a=False) == "always\neither\nlast" and W.template("x {y}") == "x {y}"
