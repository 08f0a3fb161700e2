"""strideq: temporal and sequential pattern queries over ordered event tables, as Spark plans."""

__version__ = "0.1.0"
_HOME = {"Engine": "strideq.engine", "Result": "strideq.engine", "Grouped": "strideq.engine", "Aggregate": "strideq.engine", "Corpus": "strideq.sources.corpus", "CorpusSpec": "strideq.sources.corpus"}
__all__ = [*_HOME]


def __getattr__(name: str):
    # Loaded when asked for, so that Python workers don't import the whole engine.
    if name in _HOME:
        from importlib import import_module

        return getattr(import_module(_HOME[name]), name)
    raise AttributeError(name)
