"""Registered queries over the driver tables, each with its SQL counterpart."""


def load():
    """Import every query module and return the registry."""
    from workload import asking, conversations, evaluation, exclusions, nearest, pages, registry, retrieval, streams, upkeep  # noqa: F401

    return registry
