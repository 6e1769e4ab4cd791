"""Project files: the reference, samples, pipelines and options of a comparison."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

DEFAULTS = {"min_depth": 1, "min_qual": 0.0, "min_consensus": 0.8, "include_indels": False}


@dataclass
class Config:
    reference: str
    label: str | None
    samples: dict[str, dict]
    pipelines: dict[str, dict]
    options: dict = field(default_factory=dict)
    description: str | None = None

    @property
    def truth(self) -> str | None:
        """The pipeline flagged as ground truth; the first by name if several are."""
        return next((p for p, x in sorted(self.pipelines.items()) if x.get("reference") or x.get("ground_truth")), None)

    def sample_ids(self) -> list[str]:
        """Samples that pipelines name; the samples block only labels them."""
        return sorted({s for p in self.pipelines.values() for s in p.get("samples") or {}})

    def file_paths(self) -> list[tuple[str, str, str | None, str | None]]:
        """(sample, pipeline, path of the calls, path of the alignments)."""
        return sorted((s, p, x.get("vcf"), x.get("bam")) for p, s, x in self.tasks())

    def pipeline_rows(self) -> list[tuple[str, str | None, str | None, bool, bool, bool, bool]]:
        """(pipeline, label, command, has_vcf, has_bam, reference, from_bam_pileup).  A truth with nothing but alignments
        has its calls from their pileup, which counts as having calls."""
        out = []
        for name, p in sorted(self.pipelines.items()):
            files = (p.get("samples") or {}).values()
            vcf, bam = any(x.get("vcf") for x in files), any(x.get("bam") for x in files)
            truth = bool(p.get("reference") or p.get("ground_truth"))
            piled = truth and bam and not vcf
            out.append((name, p.get("label"), p.get("command"), vcf or piled, bam, truth, piled))
        return out

    def tasks(self) -> list[tuple[str, str, dict]]:
        return [(p, s, x) for p, d in sorted(self.pipelines.items()) for s, x in sorted((d.get("samples") or {}).items())]


def load(path: str) -> Config:
    """Reads and validates a YAML project.  Without an options block every option is 0 or false; within one,
    missing options have their defaults."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML projects needs the yaml module") from e
    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f), os.path.dirname(path))


def parse(d: dict, base: str = "", check_files: bool = True) -> Config:
    ref = d.get("reference") or {}
    ref = {"path": ref} if isinstance(ref, str) else ref
    pipelines = d.get("pipelines") or {}
    if not pipelines:
        raise ValueError("a project needs a pipeline")
    options = {k: type(v)() for k, v in DEFAULTS.items()} if d.get("options") is None else DEFAULTS | d["options"]
    paths = [ref.get("path")]
    for name, p in pipelines.items():
        paths.append(p.get("core_snps"))
        for sample, x in (p.get("samples") or {}).items():
            if not (x.get("vcf") or x.get("bam")):
                raise ValueError(f"{name}/{sample} has neither calls nor alignments")
            paths += [x.get("vcf"), x.get("bam")]
    for x in paths if check_files else []:
        if x and not os.path.exists(x):
            raise FileNotFoundError(x)
    text = d.get("description")
    if text and text.endswith((".md", ".txt")) and os.path.exists(p := os.path.join(base, text)):
        with open(p, encoding="utf-8") as f:
            text = f.read()
    return Config(ref.get("path"), ref.get("label"), d.get("samples") or {}, pipelines, options, text)


def sanitized(text: str, config_dir: str, home: str) -> str:
    """A project text without the folder prefix and with the home folder as ~."""
    out = text.replace(config_dir.rstrip("/") + "/", "") if config_dir else text
    return out.replace(home, "~") if home else out


def fastq_samples(folder: str) -> list[tuple[str, str, str | None]]:
    """(sample, first file, second file) by name: a folder for each sample, or flat files marked _R1 or _1."""
    ends = (".fastq", ".fq", ".fastq.gz", ".fq.gz")
    out = []

    def pairs(place: str, parent: str | None):
        for f in sorted(os.listdir(place)):
            stem = next((f[: -len(e)] for e in sorted(ends, key=len, reverse=True) if f.endswith(e)), None)
            if stem is None or any(stem.endswith(x) for x in ("_R2", "_2")) or "_R2_" in stem:
                continue
            second, name = None, stem
            for a, b in (("_R1_", "_R2_"), ("_R1", "_R2"), ("_1", "_2")):
                if a in stem:
                    other = f.replace(a, b, 1)
                    second = os.path.join(place, other) if os.path.exists(os.path.join(place, other)) else None
                    name = stem.split(a)[0]
                    break
            if parent and name.lower() in ("", "reads", "r", "read", "sample"):
                name = parent
            out.append((name, os.path.join(place, f), second))

    for x in sorted(os.listdir(folder)):
        if os.path.isdir(os.path.join(folder, x)):
            pairs(os.path.join(folder, x), x)
    pairs(folder, None)
    return sorted(out)
