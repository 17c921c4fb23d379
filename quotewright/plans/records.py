"""Canonical JSON records, content ids, and a stage runner that verifies and skips finished stages."""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Callable
from pathlib import Path
from typing import Any


def canonical_json(value: Any) -> bytes:
    """Sorted keys, no spaces, no NaN; the same value always gives the same bytes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def content_id(value: Any) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def _unique(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def _no_constant(name: str) -> float:
    raise ValueError(f"{name} is not allowed")


def read_strict_json(path: str | Path) -> Any:
    """JSON without repeated keys, NaN or infinities."""
    value = json.loads(Path(path).read_bytes(), object_pairs_hook=_unique, parse_constant=_no_constant)
    _finite(value)
    return value


def _finite(value: Any) -> None:
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("numbers must be finite")
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _finite(v)


def write_immutable_json(path: str | Path, value: Any) -> str:
    """Write once, durably; an existing file is an error. Returns the content id."""
    with open(path, "xb") as f:
        f.write(canonical_json(value) + b"\n")
        f.flush()
        os.fsync(f.fileno())
    return content_id(value)


class StageRunner:
    """Runs named stages in order; a stage whose marker holds the same fingerprint and output ids is skipped."""

    def __init__(self, root: str | Path, config: Any):
        self.root, self.fingerprint = Path(root), content_id(config)
        self.root.mkdir(parents=True, exist_ok=True)

    def run(self, name: str, stage: Callable[[Path], None]) -> bool:
        """Whether the stage was executed; it writes below the folder it is given, which appears only when complete."""
        out, marker = self.root / name, self.root / f"{name}.json"
        if marker.exists():
            found = read_strict_json(marker)
            if found["fingerprint"] != self.fingerprint:
                raise ValueError(f"stage {name} was run with another configuration")
            if found["files"] != self._files(out):
                raise ValueError(f"the output of stage {name} was altered")
            return False
        partial = self.root / f".{name}.partial"
        if partial.exists():
            raise ValueError(f"stage {name} was interrupted: remove {partial} to run it again")
        partial.mkdir()
        stage(partial)
        partial.rename(out)
        write_immutable_json(marker, {"fingerprint": self.fingerprint, "files": self._files(out)})
        return True

    @staticmethod
    def _files(folder: Path) -> dict[str, str]:
        return {str(p.relative_to(folder)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(folder.rglob("*")) if p.is_file()}
