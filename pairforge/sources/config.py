"""Settings on the driver: readers that refuse doubtful files, validators, digests, and a guard against mixing settings in one result folder."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Names of fields that hold a secret, as a whole or at their end, and the modes of reasoning.
SECRETS, SECRET_ENDS = {"api_key", "token", "secret", "password"}, ("_token", "_secret", "_password")
MODES = {"disabled", "enabled", "required"}


def canonical_json(value: Any) -> str:  # noqa: ANN401
    """The same text for equal values: keys sorted, no blanks."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fingerprint(value: Any, n: int = 16) -> str:  # noqa: ANN401
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:n]


def read_json(path: str | Path) -> dict[str, Any]:
    """An object in which no key repeats."""

    def once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        found = dict(pairs)
        if len(found) < len(pairs):
            raise ValueError(f"{path}: a key repeats among {sorted(k for k, _ in pairs)}")
        return found

    value = json.loads(Path(path).read_text(encoding="utf-8"), object_pairs_hook=once)
    if not isinstance(value, dict):
        raise ValueError(f"{path} must hold an object")
    return value


def read_toml(path: str | Path) -> dict[str, Any]:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def known_fields(item: dict[str, Any], allowed: set[str], name: str) -> None:
    if extra := sorted(set(item) - allowed):
        raise ValueError(f"{name} has unknown fields: {extra}")


def positive_int(value: Any, name: str) -> int | None:  # noqa: ANN401
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
        raise ValueError(f"{name} must be a positive integer")
    return value


def has_secret(value: Any) -> bool:  # noqa: ANN401
    """Whether a field's name, at any depth, says that it holds a secret."""
    if isinstance(value, list):
        return any(map(has_secret, value))
    if not isinstance(value, dict):
        return False
    names = [str(k).lower().replace("-", "_") for k in value]
    return any(k in SECRETS or k.endswith(SECRET_ENDS) for k in names) or any(map(has_secret, value.values()))


def check_inference(inference: dict[str, Any], can: dict[str, Any], name: str) -> None:
    """Raises unless a judge's inference settings are whole and within what its model can do."""
    known_fields(inference, {"temperature", "max_output_tokens", "reasoning"}, name)
    known_fields(can, {"reasoning_modes", "reasoning_efforts", "temperature_allowed_during_reasoning", "seed_supported"}, name)
    reasoning, modes, efforts = inference.get("reasoning") or {}, can.get("reasoning_modes") or [], can.get("reasoning_efforts") or []
    known_fields(reasoning, {"mode", "effort"}, name)
    mode, effort, heat = reasoning.get("mode"), reasoning.get("effort"), inference.get("temperature")
    flags = [can.get("temperature_allowed_during_reasoning"), can.get("seed_supported")]
    rules = {
        "the output limit is missing": positive_int(inference.get("max_output_tokens"), f"{name}: the output limit") is None,
        "the temperature isn't a number": heat is not None and (isinstance(heat, bool) or not isinstance(heat, int | float)),
        "the mode isn't known": mode not in MODES,
        "the effort is blank": effort is not None and (not isinstance(effort, str) or not effort.strip()),
        "an effort goes with no reasoning": mode == "disabled" and effort is not None,
        "the model's modes aren't a set of known ones": not modes or len(modes) != len(set(modes)) or not set(modes) <= MODES,
        "the model's efforts aren't a set of names": len(efforts) != len(set(efforts)) or not all(isinstance(e, str) and e for e in efforts),
        "the model's flags are missing": not all(isinstance(f, bool) for f in flags),
        "a model without reasoning has efforts": set(modes) == {"disabled"} and bool(efforts),
        "the mode isn't one of the model's": mode not in modes,
        "the effort isn't one of the model's": effort is not None and effort not in efforts,
        "the model takes no temperature while it reasons": mode != "disabled" and heat is not None and not flags[0],
    }
    if broken := [why for why, is_so in rules.items() if is_so]:
        raise ValueError(f"{name}: {'; '.join(broken)}")


def distinct_judges(judges: dict[str, dict[str, Any]]) -> None:
    """Raises if two names stand for the same model with the same settings."""
    seen: dict[str, str] = {}
    for name, judge in judges.items():
        at = fingerprint({k: judge.get(k) for k in ("model", "inference", "provider_options")})
        if at in seen:
            raise ValueError(f"{name} and {seen[at]} are one judge")
        seen[at] = name


def judge_fingerprint(judge: dict[str, Any], prompt_fingerprint: str) -> str:
    """Of what a judge's answers depend on: its settings and the prompt."""
    return fingerprint({"judge": judge, "prompt": prompt_fingerprint})


def per_dataset(value: Any, dataset: str) -> Any:  # noqa: ANN401
    """A setting for all datasets, or a table of settings by dataset."""
    return value[dataset] if isinstance(value, dict) else value


def write_atomic(path: str | Path, value: Any) -> None:  # noqa: ANN401
    """A JSON file that is either the old or the new one, whatever happens meanwhile."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, ensure_ascii=False, indent=2) + "\n")
    os.replace(temp, path)


def merge_state(path: str | Path, name: str, **changes: Any) -> dict[str, Any]:  # noqa: ANN401
    """Changes fields of one batch in a state file and keeps the others."""
    state = read_json(path) if Path(path).exists() else {}
    state[name] = state.get(name, {}) | changes
    write_atomic(path, state)
    return state


def guard_settings(path: str | Path, settings: dict[str, Any]) -> None:
    """Writes a folder's settings, or raises if it has others."""
    if not Path(path).exists():
        write_atomic(path, settings)
    elif (now := read_json(path)) != settings:
        raise ValueError(f"{path} has other settings: {sorted(k for k in now.keys() | settings.keys() if now.get(k) != settings.get(k))}")


def check_dataset(spark: SparkSession, path: str, rows: int | None = None, sha256: str | None = None) -> dict[str, Any]:
    """Rows and digest of a table's files, in order of their names; raises if they aren't the expected ones. Files are hashed in tasks."""
    n = spark.read.parquet(path).count()
    digests = [r.d for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", F.sha2("content", 256).alias("d")).orderBy("path").select("d").collect()]
    digest = digests[0] if len(digests) == 1 else hashlib.sha256("".join(digests).encode()).hexdigest()
    if rows is not None and n != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    if sha256 is not None and digest != sha256:
        raise ValueError(f"{path} has digest {digest}, not {sha256}")
    return {"rows": n, "sha256": digest}
