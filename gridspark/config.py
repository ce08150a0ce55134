"""Run configuration: typed, loaded from and written to YAML or JSON."""

from __future__ import annotations

import dataclasses
import json
import logging
import os
import time
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class DataConfig:
    path: str
    lat_dim: str = "lat"
    lon_dim: str = "lon"
    time_dim: str = "time"


@dataclass(frozen=True)
class DatasetConfig:
    data: DataConfig
    features: tuple[str, ...] = ("tmax_norm", "tmin_norm", "tp_norm", "LAI_norm", "LAI_flag", "lat_norm", "lon_norm")
    lc_features: tuple[str, ...] = ()
    target: str = "LAI_norm"
    mask_var: str = "LAI_flag"
    input_seq_length: int = 15
    target_seq_length: int = 15
    patch_size: int | None = None
    stride: int = 1
    min_valid_fraction: float = 0.0

    @property
    def target_index(self) -> int:
        return self.features.index(self.target)

    @property
    def n_input_channels(self) -> int:
        return len(self.features) + len(self.lc_features)


@dataclass(frozen=True)
class RunConfig:
    dataset: DatasetConfig
    root_dir: str
    train_test_split: float
    sample: int | None = None
    time_start: str | None = None
    time_end: str | None = None
    val_start: str = "2022-01-01"
    train_loader_params: dict = field(default_factory=dict)
    val_loader_params: dict = field(default_factory=dict)
    train_params: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict) -> RunConfig:
        ds = dict(d["dataset"])
        data = DataConfig(**ds.pop("data"))
        for k in ("features", "lc_features"):
            if k in ds:
                ds[k] = tuple(ds[k])
        return cls(**{**d, "dataset": DatasetConfig(data=data, **ds)})

    @classmethod
    def load(cls, path: str) -> RunConfig:
        text = Path(path).read_text()
        if path.endswith(".json"):
            return cls.from_dict(json.loads(text))
        import yaml

        return cls.from_dict(yaml.safe_load(text))

    def to_dict(self) -> dict:
        d = dataclasses.asdict(self)
        for k in ("features", "lc_features"):
            d["dataset"][k] = list(d["dataset"][k])
        return d

    def dump(self, path: str) -> None:
        if path.endswith(".json"):
            Path(path).write_text(json.dumps(self.to_dict(), indent=2))
            return
        import yaml

        Path(path).write_text(yaml.safe_dump(self.to_dict(), sort_keys=False))

    def run_dir(self) -> Path:
        """Folder of this run, made on first use: named after the scheduler's job where there is one, else the time."""
        job = os.environ.get("SLURM_JOB_ID")
        at = Path(self.root_dir) / (f"slurm_{job}" if job else f"local_{time.strftime('%Y%m%d_%H%M%S')}")
        at.mkdir(parents=True, exist_ok=True)
        return at


def latest_checkpoint(names: list[str]) -> str | None:
    """The checkpoint with the greatest name."""
    return max((n for n in names if os.path.basename(n).startswith("checkpoint_")), default=None)


def setup_logging(file: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The library's logger, to the console and, where given, a file."""
    log = logging.getLogger("gridspark")
    log.setLevel(level)
    log.handlers.clear()
    for h in (logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])):
        h.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log
