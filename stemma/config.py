"""What a comparison needs to know, from a JSON or TOML file or from paths."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Source:
    """One edition and how it is named."""

    path: str
    doc_id: str
    title: str
    version_label: str

    @classmethod
    def of_path(cls, path: str, version_label: str) -> Source:
        stem = Path(path).stem
        return cls(str(path), stem, stem, version_label)


@dataclass(frozen=True)
class Interpreter:
    """Who is asked about changes, and about which."""

    provider: str = "chat"
    model: str = ""
    base_url: str | None = None
    key_env: str | None = None
    api_version: str | None = None
    scope: str = "core"
    batch: bool = False


@dataclass(frozen=True)
class Config:
    """A comparison: both editions, thresholds, and where results go."""

    old: Source
    new: Source
    out_dir: str
    run_name: str = "run"
    pair_label: str = ""
    similarity: str = "tfidf"
    tau: float = 0.62
    tau_moved: float = 0.72
    tau_embed: float = 0.82
    language: str = "de"
    embed_fallback: bool = False
    interpreter: Interpreter = field(default_factory=Interpreter)

    @classmethod
    def of_paths(cls, old: str, new: str, out_dir: str, **settings) -> Config:
        """A comparison of two files; names follow from theirs."""
        sides = Source.of_path(old, "old"), Source.of_path(new, "new")
        defaults = {"run_name": Path(out_dir).name or "run", "pair_label": f"{sides[0].doc_id} <-> {sides[1].doc_id}"}
        return cls(*sides, str(out_dir), **(defaults | settings))

    @classmethod
    def of_file(cls, path: str, out_dir: str) -> Config:
        """A comparison as a file describes it; keys beginning with llm_ are the interpreter's."""
        text = Path(path).read_text(encoding="utf-8")
        data = tomllib.loads(text) if path.lower().endswith(".toml") else json.loads(text)
        sides = [Source(**{k: data[e][k] for k in ("path", "doc_id", "title", "version_label")}) for e in ("old", "new")]
        own = {k.removeprefix("llm_"): v for k, v in data.items() if k.startswith("llm_")}
        if "deutung_scope" in data:
            own["scope"] = data["deutung_scope"]
        known = {k: data[k] for k in cls.__dataclass_fields__ if k in data and k not in ("old", "new", "out_dir", "interpreter")}
        return cls(*sides, str(out_dir), interpreter=Interpreter(**own), **known)

    def tau_for(self, formats: tuple[str, str]) -> float:
        """The threshold of the similarity pass: lower where exactly one side comes from a PDF file."""
        return self.tau - 0.05 if formats.count("pdf") == 1 else self.tau
