"""Word-history analytics on Spark."""

__all__ = ["Engine", "Result", "parse"]


def __getattr__(name: str):
    if name in __all__:  # loaded at first use, so that workers that need one function load no more
        from . import engine

        return getattr(engine, name)
    raise AttributeError(name)
