"""Setting a repository up: a push hook that offers a review, and a starter configuration."""

from __future__ import annotations

import os
import shlex
import tempfile
from pathlib import Path

from ..errors import ConfigError, GitFailed
from .git import git

MARKER = "# managed by reviewlake"
STARTER = "# base: main\n# report_path: review-report.md\n# questions: 3\n# include_uncommitted: false\n# exclude:\n#   - generated/**\n"


def hook_script(base: str | None = None) -> str:
    """A POSIX script that asks at the terminal, runs a review on yes, and never stops a push."""
    command = "python -m reviewlake review" + (f" --base {shlex.quote(base)}" if base else "")
    return f"""#!/bin/sh
{MARKER}
{{ : </dev/tty; }} 2>/dev/null || exit 0
printf 'Review this branch before pushing? [y/N] ' >/dev/tty
read -r reply </dev/tty || reply=
case $reply in [Yy]*) {command} </dev/tty || : ;; esac
exit 0
"""


def hook_path(root: str) -> Path:
    """Where Git looks for the hook, a configured hooks folder included."""
    found = git(root, "rev-parse", "--git-path", "hooks/pre-push").decode().strip()
    path = Path(found)
    return path if path.is_absolute() else Path(root) / path


def install_hook(path: Path, script: str, force: bool = False) -> str:
    """"installed", "already-current" or "updated". A hook of someone else's is replaced only by force."""
    if path.exists() or path.is_symlink():
        old = path.read_bytes()[:65_536].decode("utf-8", "replace")
        if old == script and os.access(path, os.X_OK):
            return "already-current"
        if MARKER not in old.split("\n") and not force:
            raise GitFailed("There is a hook already that is not managed here.", "Use --force to replace it.", str(path))
        state = "updated"
    else:
        state = "installed"
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, new = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w", encoding="utf-8", newline="\n") as f:
        f.write(script)
    os.chmod(new, 0o755)
    os.replace(new, path)
    return state


def write_starter(path: Path) -> None:
    """A configuration with every key commented out; an existing file is left alone."""
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        with path.open("x", encoding="utf-8", newline="\n") as f:
            f.write(STARTER)
    except FileExistsError as e:
        raise ConfigError("The configuration exists already.", "Choose another path or remove it.", str(path)) from e
