"""Facts about a git work tree, read on the driver through the git command."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import subprocess
import tempfile


def _git(folder: str, *args: str, timeout: int = 30) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def top_level(folder: str) -> str | None:
    return _git(folder, "rev-parse", "--show-toplevel") or None


def head_commit(folder: str) -> str:
    """The commit of a work tree's root; other folders get a name of their own."""
    top = top_level(folder)
    if top and os.path.realpath(top) == os.path.realpath(folder):
        return _git(folder, "rev-parse", "HEAD") or "unknown"
    return "local-" + hashlib.sha256(os.path.abspath(folder).encode()).hexdigest()[:12]


def changed_files(folder: str, old: str, new: str) -> list[str]:
    return [x.strip() for x in (_git(folder, "diff", "--name-only", old, new) or "").splitlines() if x.strip()]


def commit_subject(folder: str, commit: str = "HEAD") -> str:
    return _git(folder, "log", "-1", "--format=%s", commit) or ""


def commit_tag(folder: str, commit: str = "HEAD") -> str | None:
    found = (_git(folder, "tag", "--points-at", commit) or "").splitlines()
    return found[0] if found else None


def shallow_clone(address: str, cache: str, timeout: int = 300) -> str | None:
    """A shallow clone in ``cache`` that replaces an older one; None if that fails.

    Needs a network where the address is remote.
    """
    name = re.sub(r"\.git$", "", address.rstrip("/").rsplit("/", 1)[-1]) or "repository"
    os.makedirs(cache, exist_ok=True)
    target, fresh = os.path.join(cache, name), tempfile.mkdtemp(dir=cache)
    if _git(cache, "clone", "--depth", "1", "--", address, os.path.join(fresh, name), timeout=timeout) is None:
        shutil.rmtree(fresh, ignore_errors=True)
        return None
    shutil.rmtree(target, ignore_errors=True)
    shutil.move(os.path.join(fresh, name), target)
    shutil.rmtree(fresh, ignore_errors=True)
    return target
