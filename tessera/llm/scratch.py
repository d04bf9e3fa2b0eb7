"""Tables that cut lineage: see ``tessera.tables``."""

import uuid

from ..tables import drop, keep, place, root


def fresh() -> str:
    """A name that no other call has."""
    return uuid.uuid4().hex


__all__ = ["drop", "fresh", "keep", "place", "root"]
