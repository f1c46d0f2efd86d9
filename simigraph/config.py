"""Options of the engine, as one tree of frozen dataclasses."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


# Names, order and defaults of all options below are the schema of the users' YAML files.


@dataclass(frozen=True)
class Scan:
    include_extensions: tuple[str, ...] = ()
    exclude_folders: tuple[str, ...] = ()


@dataclass(frozen=True)
class Normalization:
    lowercase: bool = True
    remove_punctuation: bool = True
    replace_separators: bool = True
    remove_stop_words: bool = True
    strip_hashes: bool = True
    remove_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Algorithms:
    exact_match: bool = True
    token_similarity: bool = True
    fuzzy_similarity: bool = True
    ngram_similarity: bool = True
    char_frequency: bool = True
    size_similarity: bool = True
    numeric_validation: bool = True
    extension_intelligence: bool = True
    folder_context: bool = True
    semantic_similarity: bool = False


@dataclass(frozen=True)
class Weights:
    exact_match: float = 40.0
    token_similarity: float = 20.0
    fuzzy_similarity: float = 15.0
    ngram_similarity: float = 10.0
    char_frequency: float = 5.0
    size_similarity: float = 5.0
    numeric_validation: float = 5.0
    extension_intelligence: float = 0.0
    folder_context: float = 0.0
    semantic_similarity: float = 10.0


@dataclass(frozen=True)
class Thresholds:
    almost_certain: float = 95.0
    highly_likely: float = 80.0
    potential: float = 60.0
    weak: float = 40.0


@dataclass(frozen=True)
class Blocking:
    max_block_size: int = 500
    min_token_length: int = 3
    prefix_length: int = 4
    use_extension_category: bool = True
    use_length_bucket: bool = True
    use_token_signature: bool = True


@dataclass(frozen=True)
class Config:
    scan: Scan = field(default_factory=Scan)
    normalization: Normalization = field(default_factory=Normalization)
    algorithms: Algorithms = field(default_factory=Algorithms)
    weights: Weights = field(default_factory=Weights)
    thresholds: Thresholds = field(default_factory=Thresholds)
    blocking: Blocking = field(default_factory=Blocking)

    def merged(self, changes: Mapping[str, Any]) -> Config:
        """With the values of a nested mapping in place of the defaults; lists replace lists."""
        return _merged(self, changes)


def _merged(part: Any, changes: Mapping[str, Any]) -> Any:
    known = {f.name for f in dataclasses.fields(part)}
    new = {}
    for k, v in changes.items():
        if k in known:
            old = getattr(part, k)
            if dataclasses.is_dataclass(old):
                v = _merged(old, v or {})
            elif isinstance(old, tuple):
                v = tuple(v)
            new[k] = v
    return dataclasses.replace(part, **new)


def load(path: str) -> Config:
    """From a YAML file, which is written with the defaults if it isn't there."""
    try:
        import yaml
    except ImportError as e:  # YAML is optional
        raise RuntimeError("reading YAML needs the yaml package") from e
    file = Path(path)
    if not file.exists():
        file.parent.mkdir(parents=True, exist_ok=True)
        plain = {k: {n: list(x) if isinstance(x, tuple) else x for n, x in v.items()} for k, v in dataclasses.asdict(Config()).items()}
        file.write_text(yaml.safe_dump(plain))
    return Config().merged(yaml.safe_load(file.read_text()) or {})
