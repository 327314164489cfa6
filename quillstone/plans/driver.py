"""Driver-side pieces of a run: configuration, resume rules, phase journal, single-writer lock."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import tomllib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from quillstone.sources.writers import save_json


@dataclass(frozen=True)
class EvalConfig:
    """Adaptive evaluation."""

    target_ci_pp: float = 2.0
    p_value: float = 0.05
    batch_size: int = 40
    min_sample_size: int = 40
    max_sample_size: int = 200

    @property
    def target_half_width(self) -> float:
        return self.target_ci_pp / 100


@dataclass(frozen=True)
class LoopConfig:
    """A run. Unknown keys of a file are ignored, missing ones have these defaults."""

    generate_target: int = 400
    heldout_fraction: float = 0.1
    min_delta: float = 0.005
    noise_z: float = 1.0
    patience: int = 2
    save_every: int = 10
    train_max_steps: int = 20
    seed: int = 0
    eval: EvalConfig = field(default_factory=EvalConfig)

    def check(self) -> LoopConfig:
        e = self.eval
        rules = {
            "heldout_fraction": 0 < self.heldout_fraction < 1,
            "p_value": 0 < e.p_value < 1,
            "batch_size": e.batch_size > 0,
            "max_sample_size": e.max_sample_size >= e.min_sample_size > 0,
            "target_ci_pp": e.target_ci_pp > 0,
            "generate_target": self.generate_target > 0,
            "save_every": 0 < self.save_every <= self.train_max_steps,
        }
        bad = [name for name, ok in rules.items() if not ok]
        if bad:
            raise ValueError(f"out of range: {', '.join(bad)}")
        return self


def _known(cls: type, raw: dict[str, Any] | None) -> dict[str, Any]:
    names = {f.name for f in fields(cls)}
    return {k: v for k, v in (raw or {}).items() if k in names}


def load_config(path: str | Path | None = None) -> LoopConfig:
    """TOML with defaults; the path may come from LOOP_CONFIG."""
    path = path or os.environ.get("LOOP_CONFIG")
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    top = _known(LoopConfig, raw.get("loop", raw))
    top.pop("eval", None)
    return LoopConfig(**top, eval=EvalConfig(**_known(EvalConfig, raw.get("eval")))).check()


#: Settings that a resumed run cannot change.
IMMUTABLE = ("seed", "heldout_fraction")


def resume(saved: dict[str, Any], explicit: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
    """(settings, overrides): explicit settings win over saved ones; immutable ones must agree."""
    changed = {k: {"from": saved.get(k), "to": v} for k, v in explicit.items() if saved.get(k) != v}
    fixed = [k for k in changed if k in IMMUTABLE]
    if fixed:
        raise ValueError(f"a resumed run cannot change {', '.join(fixed)}")
    return {**saved, **explicit}, changed


class Journal:
    """Completed phases of an iteration; a resumed iteration skips them."""

    def __init__(self, directory: str | Path, iteration: int, config: LoopConfig):
        self.path = Path(directory) / "journal.json"
        if self.path.exists():
            self.data = json.loads(self.path.read_text(encoding="utf-8"))
            if self.data["config"] != asdict(config) or self.data["iteration"] != iteration:
                raise ValueError("the journal belongs to another configuration")
            return
        if self.path.parent.exists() and any(self.path.parent.iterdir()):
            raise ValueError("the directory holds files but no journal")
        self.data = {
            "iteration": iteration, "started_at": datetime.now(UTC).isoformat(), "config": asdict(config), "completed_phases": [], "phase_data": {},
        }
        save_json(self.path, self.data)

    def done(self, phase: str) -> bool:
        return phase in self.data["completed_phases"]

    def mark(self, phase: str, **data: Any) -> None:
        if not self.done(phase):
            self.data["completed_phases"].append(phase)
        self.data["phase_data"][phase] = data
        save_json(self.path, self.data)


@contextlib.contextmanager
def run_lock(directory: str | Path) -> Iterator[None]:
    """One writer a run directory; a second one fails at once."""
    Path(directory).mkdir(parents=True, exist_ok=True)
    with open(Path(directory) / ".lock", "a", encoding="utf-8") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise RuntimeError("another process writes this run") from e
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def configuration_drift(expected: dict[str, Any], actual: dict[str, Any]) -> list[str]:
    """A warning for each setting that differs between two configurations."""
    return [f"{k}: expected {expected[k]!r}, found {actual.get(k)!r}" for k in sorted(expected) if actual.get(k) != expected[k]]
