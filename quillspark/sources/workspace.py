"""Driver-side work on a workspace's folder: clearing, waiting, copying in and out, templates. root: any folder that pyarrow can name."""

from __future__ import annotations

import posixpath
import re
import time
from collections.abc import Callable, Iterable

import pyarrow.fs as pafs

from .writers import filesystem

MARK = re.compile(r"\[([A-Za-z_]\w*)\]")


def inside(path: str) -> str:
    """A path in the workspace in its normal form; an error for the workspace itself and for what lies outside."""
    normal = posixpath.normpath(path.strip().replace("\\", "/"))
    if normal in ("", ".") or normal.startswith(("/", "../", "~")) or normal == "..":
        raise ValueError(f"not a path inside the workspace: {path!r}")
    return normal


def clear(root: str, paths: Iterable[str]) -> list[str]:
    """Deletes files and folders; what isn't there, and what isn't inside, is left alone. Returns what went."""
    fs, base = filesystem(root)
    gone = []
    for path in paths:
        try:
            target = f"{base.rstrip('/')}/{inside(path)}"
        except ValueError:
            continue
        kind = fs.get_file_info(target).type
        if kind == pafs.FileType.Directory:
            fs.delete_dir(target)
        elif kind == pafs.FileType.File:
            fs.delete_file(target)
        else:
            continue
        gone.append(path)
    return gone


def wait_for(root: str, paths: Iterable[str], poll: float = 5, most: float | None = None, sleep: Callable[[float], None] = time.sleep) -> float:
    """Waits until all paths are there; returns the seconds that it took. most: an error after so many."""
    fs, base = filesystem(root)
    targets = [f"{base.rstrip('/')}/{inside(p)}" for p in paths]
    began = time.monotonic()
    while any(i.type == pafs.FileType.NotFound for i in fs.get_file_info(targets)):
        if most is not None and time.monotonic() - began >= most:
            raise TimeoutError(f"still missing after {most} s: {targets}")
        sleep(poll)
    return time.monotonic() - began


def copy(source_root: str, source: str, target_root: str, target: str, overwrite: bool = False) -> int:
    """Copies one file between folders, under a temporary name first; returns its bytes."""
    a, from_base = filesystem(source_root)
    b, to_base = filesystem(target_root)
    origin, end = f"{from_base.rstrip('/')}/{inside(source)}", f"{to_base.rstrip('/')}/{inside(target)}"
    if not overwrite and b.get_file_info(end).type != pafs.FileType.NotFound:
        raise FileExistsError(target)
    b.create_dir(posixpath.dirname(end), recursive=True)
    size = 0
    with a.open_input_stream(origin, compression=None) as take, b.open_output_stream(end + ".tmp", compression=None) as put:
        while part := take.read(1 << 20):
            put.write(part)
            size += len(part)
    b.move(end + ".tmp", end)
    return size


def template(text: str, **values: object) -> str:
    """A template's lines without marks, and those of which a mark's flag is true; then its fields filled in."""
    flags = {k for k, v in values.items() if v is True}
    fields = {k: v for k, v in values.items() if not isinstance(v, bool)}
    kept = []
    for line in text.split("\n"):
        marks = set(MARK.findall(line))
        if not marks or marks & flags:
            kept.append(MARK.sub("", line).lstrip())
    out = "\n".join(kept)
    return out.format(**fields).strip() if fields else out
