"""All registered queries of the statistics engine, by key, with the SQL each is compared with."""

from . import geometry, indices, ledgers, linking, pages, policies, ranking, roundtrips, scalars, surfaces, versions  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
