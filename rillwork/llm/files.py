"""Whole files in shared folders, opened from tasks."""

from __future__ import annotations

from urllib.parse import unquote, urlparse


def opened(uri: str):
    """(file system, path) of a path or URI that every executor reaches."""
    from pyarrow import fs

    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path) if scheme else uri
    return fs.FileSystem.from_uri(uri)
