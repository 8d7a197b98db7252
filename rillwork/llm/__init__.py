"""Operations of a training-data pipeline; nothing else in the package imports this subpackage."""

from importlib import import_module

MODULES = ["packing", "mixing", "warc", "spans", "language", "toxicity", "quality", "minhash", "forest", "substrings", "variants", "divergence", "tokenfiles"]


def load():
    """All queries and their SQL twins."""
    queries, oracles = {}, {}
    for m in MODULES:
        module = import_module(f"rillwork.llm.{m}")
        queries.update(module.QUERIES)
        oracles.update(getattr(module, "ORACLES", {}))
    pipeline = import_module("corpus_pipeline")
    queries["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL:
        oracles["pipeline"] = pipeline.ORACLE_SQL
    return queries, oracles
