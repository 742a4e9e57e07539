"""Parameter defaults of the memory analytics, in one place."""

from __future__ import annotations

from dataclasses import dataclass

#: The fixed clock of queries on the provided tables; nothing reads the wall clock.
REF = "2024-02-01 00:00:00"


@dataclass(frozen=True)
class Params:
    # scoring weights of topic, emotion, time and importance
    topic: float = 4.0
    emotion: float = 2.0
    time: float = 2.5
    importance: float = 1.0
    keyword_floor: float = 50.0
    relevance_floor: float = 40.0
    tie_band: float = 3.0
    rrf_k: int = 60
    vector_floor: float = 0.5
    # activity decay
    decay_lambda: float = 0.05
    decay_threshold: float = 0.3
    emotion_base: float = 1.0
    arousal_boost: float = 0.8
    # retrieval decay
    half_life_days: float = 14.0
    min_decay: float = 0.25
    decay_weight: float = 0.4
    rehearsal: float = 0.5
    # maintenance
    duplicate: float = 0.85
    stale_days: int = 14
    ripple_hours: int = 48
    session_gap_s: int = 3600
    session_ttl_days: int = 2
    episode_lookback_days: int = 30
    session_keys: int = 1024
    # graph
    hop1: float = 0.4
    hop2: float = 0.7
    hop2_factor: float = 0.6
    # state
    tau_s: float = 900.0
    retry_s: int = 60
    retry_cap_s: int = 3600
    universal_world: str = "shared"
    # the store's local zone
    zone: str = "Asia/Shanghai"
    # merging
    merge_keyword: float = 85.0
    merge_vector: float = 0.78


DEFAULTS = Params()


def layered(env: dict[str, str], file: dict, prefix: str = "EMBERLINE_") -> dict[str, tuple[object, str]]:
    """Each parameter's value and where it is from: the environment, else the file, else the
    default. Values take the default's type; one that can't raises ValueError, as unknown names do."""
    import dataclasses

    fields = {f.name: f.default for f in dataclasses.fields(Params)}
    named = {k.removeprefix(prefix).lower(): v for k, v in env.items() if k.startswith(prefix)}
    if unknown := (set(named) | set(file)) - set(fields):
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    out = {}
    for name, default in fields.items():
        value, source = (named[name], "env") if name in named else (file[name], "file") if name in file else (default, "default")
        out[name] = (type(default)(value), source)
    return out
