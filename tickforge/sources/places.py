"""Paths of any store, as pyarrow sees them."""

from __future__ import annotations

import os
import re


def store(path: str):
    """(filesystem, path there) of a local path or a URI."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)
