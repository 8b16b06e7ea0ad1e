"""Files of any store that pyarrow knows, opened on the executors by the paths that Spark's listings give."""

from __future__ import annotations

from urllib.parse import quote


def at(path: str):
    """A path's file system and its place there. A path without a scheme is local; s3a and s3n are names of s3; blanks
    and other letters stand as they are, not as a URI's escapes."""
    import pyarrow.fs as pafs

    kind, sep, rest = path.partition("://")
    if not sep:
        kind, rest = "file", path.removeprefix("file:")
    if kind == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{'s3' if kind in ('s3a', 's3n') else kind}://{quote(rest, safe='/:@')}")


def opened(path: str):
    """For reading at any place."""
    fs, inner = at(path)
    return fs.open_input_file(inner)
