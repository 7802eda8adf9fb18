"""Settings: defaults, then layers of nested maps, then arguments; a later layer wins leaf by leaf."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# The names and defaults of all parameters.
DEFAULTS: dict[str, Any] = {
    "library": "unstranded", "paired": None, "min_mapq": 30, "biotype_attribute": "gene_biotype", "skip_dup_check": False, "min_intron": 50, "library_prep": None,
    "junction_saturation": {"enabled": True, "seed": 42, "min_coverage": 1, "percentile_floor": 5, "percentile_ceiling": 100, "percentile_step": 5},
    "inner_distance": {"enabled": True, "sample_size": 1_000_000, "lower_bound": -250, "upper_bound": 250, "step": 5},
    "tin": {"enabled": True, "sample_size": 100, "min_coverage": 10},
    "complexity": {"enabled": True, "seed": 408, "max_extrap": 1e10, "step": 1e6, "n_bootstraps": 100, "longest": 100_000_000, "confidence": 0.95, "max_terms": 100},
    "read_duplication": {"enabled": True}, "min_gene_reads": 20, "stranded": None, "panels": None, "sample_name": None, "flat_output": False,
    "dupradar": {"dup_matrix": True, "intercept_slope": True, "density_scatter_plot": True, "boxplot": True, "expression_histogram": True, "multiqc_intercept": True, "multiqc_curve": True},
    "featurecounts": {"counts_file": True, "summary_file": True, "biotype_summary_file": True, "biotype_counts": True, "biotype_counts_mqc": True, "biotype_rrna_mqc": True, "biotype_attribute": "gene_biotype"},
    "bam_stat": {"enabled": True}, "infer_experiment": {"enabled": True, "sample_size": 200_000}, "read_distribution": {"enabled": True}, "junction_annotation": {"enabled": True, "min_intron": 50},
    "flagstat": {"enabled": True}, "idxstats": {"enabled": True}, "samtools_stats": {"enabled": True}, "qualimap": {"enabled": True}, "saturation_fractions": [0.05, 0.10, 0.25, 0.50, 0.75, 1.00], "chromosome_prefix": "", "chromosome_mapping": {},
}


#: Names that a file may use for a setting of another name here: section, name, our section, our name.
ALIASES = [
    *(("preseq", a, "complexity", b) for a, b in (("enabled", "enabled"), ("max_extrap", "max_extrap"), ("step_size", "step"), ("n_bootstraps", "n_bootstraps"), ("confidence_level", "confidence"), ("seed", "seed"), ("max_terms", "max_terms"), ("max_segment_length", "longest"))),
    ("junction_annotation", "min_intron", None, "min_intron"), ("featurecounts", "biotype_attribute", None, "biotype_attribute"),
]


def renamed(layer: dict) -> dict:
    """A layer in our names. Settings stand under `rna` or at the top; inert ones (defects, tin.seed) are dropped."""
    out = copy.deepcopy(layer.get("rna") or layer)
    out.get("tin", {}).pop("seed", None)
    for section, name, own, ours in ALIASES:
        if name in (out.get(section) or {}):
            value = out[section].pop(name) if section == "preseq" else out[section][name]
            (out.setdefault(own, {}) if own else out)[ours] = value
    out.get("preseq", {}).pop("defects", None)
    if not out.get("preseq", True):
        out.pop("preseq")
    if out.get("stranded"):
        out["library"] = str(out["stranded"]).lower()
    return out


def merge(base: dict, over: dict, free: tuple[str, ...] = ("chromosome_mapping",)) -> dict:
    """over's leaves in base's places; a name that base does not know is an error."""
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        if k not in out:
            raise ValueError(f"unknown setting: {k}")
        if k in free:
            out[k] = {**out[k], **(v or {})}
            continue
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(path: str) -> dict:
    """A YAML layer where a YAML reader is installed, else JSON."""
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


@dataclass(frozen=True)
class Params:
    values: dict[str, Any] = field(default_factory=lambda: copy.deepcopy(DEFAULTS))

    @classmethod
    def of(cls, *layers: dict, **arguments: Any) -> Params:
        out = DEFAULTS
        for layer in (*map(renamed, layers), arguments):
            out = merge(out, layer)
        return cls(out)

    def __getitem__(self, key: str) -> Any:
        return self.values[key]


def fractions(text: str) -> list[float]:
    """A list of fractions; items that are no number are dropped."""
    out = []
    for item in text.split(","):
        try:
            out.append(float(item))
        except ValueError:
            continue
    return out
