"""Indexing and searching by configured options."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from lexweave.config import Config
from lexweave.functions.text import read_stop_words
from lexweave.operators import index as ix, store
from lexweave.operators.layers import strategy
from lexweave.plans import search


def build(docs: DataFrame, config: Config, **columns: str) -> ix.Index:
    """An index of a table of documents; ``columns`` name its key, body, url and docno."""
    fmt = "text" if config.document_collection_format == "text" else "html"
    return ix.build(docs, fmt=fmt, positions=config.include_positions, **columns)


def layer(index: ix.Index, path: str, config: Config) -> store.Stored:
    """Store an index with the configured layers."""
    if strategy(config.layering_strategy).layers != config.num_layers:
        raise ValueError(f"{config.layering_strategy} doesn't have {config.num_layers} layers")
    return store.write(index, path, config.layering_strategy)


def run(index: ix.Index, queries: DataFrame, config: Config, name: str = "run") -> DataFrame:
    """Lines of the configured format for queries (qid, query)."""
    stop = read_stop_words(Path(config.stop_words_list_filename).read_text()) if config.stop_words_list_filename else ()
    algorithm = config.query_algorithm
    if algorithm == "default" and config.use_positions:
        algorithm = "daat-and-top-positions"
    needs = search.NEEDS.get(algorithm, (0, None))[0]
    layering = index.layering if isinstance(index, store.Stored) else config.layering_strategy if needs else None
    results = search.search(index, queries, algorithm, config.max_number_results, stop, layering, config.overlapping_layers)
    return search.format_results(results, index, config.result_format, name, queries)
