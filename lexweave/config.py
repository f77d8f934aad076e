"""Options: key = value files, override strings and index names."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from pathlib import Path

_LINE = re.compile(r"^\s*([^\s=#]+)\s*=\s*([^\s#]+)")


def parse_pairs(text: str) -> dict[str, str]:
    """Pairs of ``key = value # comment`` lines; the last of a key wins."""
    return {m[1]: m[2] for m in map(_LINE.match, text.splitlines()) if m}


def parse_overrides(text: str) -> dict[str, str]:
    """Pairs of ``k1=v1;k2=v2;``."""
    pairs = (p.partition("=") for p in text.split(";") if p.strip())
    return {k.strip(): v.strip() for k, eq, v in pairs if eq and k.strip()}


def parse_index_name(name: str) -> tuple[str, int | None, int | None]:
    """``prefix`` or ``prefix:group.file``."""
    m = re.fullmatch(r"(.+?)(?::(\d+)\.(\d+))?", name)
    if not m:
        raise ValueError(f"not an index name: {name!r}")
    return m[1], *(int(g) if g is not None else None for g in m.groups()[1:])


def _typed(kind: str, value: str) -> object:
    if kind == "bool":
        if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"not a truth value: {value!r}")
        return value.lower() in ("true", "1", "yes")
    return {"int": int, "float": float, "str": str}[kind](value)


@dataclass(frozen=True)
class Config:
    """Options that change results or stored form."""

    document_collection_format: str = "text"
    include_positions: bool = False
    include_contexts: bool = False
    overlapping_layers: bool = False
    num_layers: int = 2
    layering_strategy: str = "percentage_2"
    max_number_results: int = 10
    use_positions: bool = False
    query_algorithm: str = "default"
    result_format: str = "normal"
    stop_words_list_filename: str = ""
    batch_query_input_file: str = ""
    indexing_doc_id_coding: str = "s16"
    indexing_frequency_coding: str = "s9"
    indexing_position_coding: str = "s16"
    indexing_block_header_coding: str = "s16"
    merging_doc_id_coding: str = "s16"
    merging_frequency_coding: str = "s9"
    merging_position_coding: str = "s16"
    merging_block_header_coding: str = "s16"

    def override(self, pairs: dict[str, str] | str) -> Config:
        """A copy with some options set from strings; unknown keys are ignored."""
        pairs = parse_overrides(pairs) if isinstance(pairs, str) else pairs
        kinds = {f.name: str(f.type) for f in fields(self)}
        return replace(self, **{k: _typed(kinds[k], v) for k, v in pairs.items() if k in kinds})

    @classmethod
    def load(cls, path: str) -> Config:
        return cls().override(parse_pairs(Path(path).read_text()))
