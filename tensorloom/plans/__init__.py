"""Query plans: ordered scans that tolerate hot keys, and the registered queries."""

from importlib import import_module

FAMILIES = (
    "tensors",
    "sequences",
    "datasets",
    "training",
    "contracts",
    "artifacts",
    "graphs",
    "intervals",
    "monitor",
    "streams",
    "user_functions",
)


def load_queries() -> None:
    """Import every module that registers queries."""
    for family in FAMILIES:
        import_module(f"{__name__}.{family}_queries")
