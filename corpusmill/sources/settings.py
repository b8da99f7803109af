"""Settings of a process from the environment and a .env file, and typed settings of a run from a YAML or JSON file."""

from __future__ import annotations

import dataclasses
import json
import os
import typing
from dataclasses import dataclass
from pathlib import Path

PREFIX = "TF_"


@dataclass(frozen=True)
class Settings:
    """Fields are read from TF_<FIELD>; the API key also from the name that its service expects, if that is given."""

    host: str = "0.0.0.0"
    port: int = 8000
    log_level: str = "INFO"
    log_json: bool = False
    api_key: str | None = None
    default_base_model: str = "Qwen/Qwen3-8B"
    dry_run: bool = True
    artifacts_dir: str = "./runs"
    max_concurrent_jobs: int = 2
    wandb_project: str | None = None
    wandb_entity: str | None = None
    wandb_mode: str = "online"

    def ensure_dirs(self) -> None:
        for part in ("jobs", "checkpoints"):
            os.makedirs(os.path.join(self.artifacts_dir, part), exist_ok=True)


def dotenv(path: str = ".env") -> dict[str, str]:
    """NAME=value lines; blank lines and # lines are skipped, quotes around a value dropped. No file: none."""
    if not os.path.exists(path):
        return {}
    pairs = (line.strip().removeprefix("export ").partition("=") for line in Path(path).read_text(encoding="utf-8").splitlines())
    return {k.strip(): v.strip().strip("\"'") for k, eq, v in pairs if eq and not k.startswith("#")}


def _typed(value, kind):
    """A value as a field's type; strings of the environment are converted."""
    if typing.get_origin(kind) is not None or type(kind).__name__ == "UnionType":
        kinds = [k for k in typing.get_args(kind) if k is not type(None)]
        return None if value is None else _typed(value, kinds[0])
    if dataclasses.is_dataclass(kind):
        return typed(value, kind)
    if kind is bool and isinstance(value, str):
        if value.lower() not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
            raise ValueError(f"{value!r} is no boolean")
        return value.lower() in ("1", "true", "yes", "on")
    return kind(value) if kind in (int, float, str, bool) else value


def settings(environment: dict[str, str] | None = None, path: str = ".env", api_key_name: str | None = None) -> Settings:
    """The environment's values over those of the file; names that no field has are left alone."""
    known = dotenv(path) | dict(os.environ if environment is None else environment)
    known = {k.upper(): v for k, v in known.items()}
    kinds = typing.get_type_hints(Settings)
    names = {f.name: PREFIX + f.name.upper() for f in dataclasses.fields(Settings)} | ({"api_key": api_key_name} if api_key_name else {})
    return Settings(**{f: _typed(known[n], kinds[f]) for f, n in names.items() if n in known})


def typed(values: dict, kind: type):
    """A dataclass from a mapping, nested ones too; an unknown name is a ValueError."""
    kinds = typing.get_type_hints(kind)
    if unknown := set(values) - set(kinds):
        raise ValueError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    return kind(**{k: _typed(v, kinds[k]) for k, v in values.items()})


def read_config(path: str) -> dict:
    """The mapping in a YAML file (where a YAML library is installed) or a JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml library") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)
