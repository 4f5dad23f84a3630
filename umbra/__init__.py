"""A PySpark engine that finds, rewrites and audits sensitive information."""

__version__ = "0.2.0"
__all__ = [
    "BackendRegistry", "Document", "Entity", "MediaType", "RedactionMode", "RedactionOptions", "RedactionResult", "RedactionSuite", "RoutingError",
    "candidates", "detect_media_type", "iter_documents", "load_document", "select_backend", "__version__",
]


def __getattr__(name: str):
    """The names of ``umbra.api``, loaded when first asked for."""
    if name in __all__:
        from umbra import api

        return getattr(api, name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
