"""Paths and fingerprints of configuration files."""

from __future__ import annotations

import hashlib
import os

from sparkloom.storage import open_folder


def normal_path(path: str, root: str) -> str:
    """A path below ``root`` without it, with forward slashes; any other path absolute."""
    whole, base = os.path.abspath(os.path.join(root, path)), os.path.abspath(root)
    return os.path.relpath(whole, base).replace(os.sep, "/") if os.path.commonpath([whole, base]) == base else whole.replace(os.sep, "/")


def fingerprint(path: str) -> str:
    """``sha256:`` and the digest of a file's bytes."""
    system, place = open_folder(path)
    digest = hashlib.sha256()
    with system.open_input_stream(place) as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return "sha256:" + digest.hexdigest()
