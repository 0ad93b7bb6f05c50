"""Settings, read from YAML files with the format's own keys: one file on the driver, folders of them in tasks."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path

# Default settings of the evidence plans.
WINDOWS = (("last_90_days", 90), ("last_180_days", 180), ("last_365_days", 365))
METHODS = ("deberta_absa", "distilled_proxy", "none")
# Keys of the settings file that differ from the names used here.
KEYS = {"semantic_grouping_method": "grouping_method", "semantic_similarity_threshold": "similarity_threshold", "allowed_absa_methods": "allowed_methods", "forbidden_dataset_names": "forbidden_tokens", "require_minilm_verified": "require_verified"}


@dataclass(frozen=True)
class Settings:
    """What the evidence plans need to know; every field has a default."""

    dataset_namespace: str = "REVIEWS"
    grouping_method: str = "complete_linkage"
    similarity_threshold: float = 0.80
    random_seed: int = 0
    representatives_per_cluster: int = 3
    require_verified: bool = True
    windows: tuple[tuple[str, int], ...] = WINDOWS
    allowed_methods: tuple[str, ...] = METHODS
    forbidden_tokens: tuple[str, ...] = ()
    polarity_mode: str = "numeric"  # or "labelled"


def parse_yaml(text: str, name: str) -> dict:
    """A YAML text's mapping; anything else in it is an error."""
    import yaml

    found = yaml.safe_load(text)
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{name} holds no mapping")
    return found or {}


def read_yaml(path: str) -> dict:
    return parse_yaml(Path(path).read_text(encoding="utf-8"), path)


def load_settings(path: str | None = None, windows_path: str | None = None, base: Settings = Settings()) -> Settings:
    """base with the keys of a settings file and the windows of another laid over it.

    Each value is brought to its default's type; unknown keys are an error.
    """
    given = read_yaml(path) if path else {}
    if windows_path:
        given["windows"] = read_yaml(windows_path).get("windows") or {}
        if not given["windows"]:
            raise ValueError(f"{windows_path} names no windows")
    return laid_over(base, given)


def laid_over(base: Settings, found: dict) -> Settings:
    """base with a settings mapping laid over it."""
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(Settings)}
    given = {KEYS.get(k, k): v for k, v in found.items()}
    if odd := sorted(set(given) - set(kinds)):
        raise ValueError(f"unknown settings: {odd}")
    if isinstance(given.get("windows"), dict):
        given["windows"] = [(str(k), int(n)) for k, n in given["windows"].items()]
    return replace(base, **{k: kinds[k](v) for k, v in given.items()})


def resolved(base: str, value: str) -> Path:
    """A path of a settings file: relative ones start at that file's folder."""
    path = Path(value).expanduser()
    return path if path.is_absolute() else (Path(base).parent / path).resolve()
