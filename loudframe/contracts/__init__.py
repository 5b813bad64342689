"""Contract queries on the shared tables, each with an independent SQL statement where SQL can say it."""

from loudframe.contracts import frames, ledger, listed, measured, reports, signal, streams, tags  # noqa: F401
from loudframe.contracts.roles import ORACLES, QUERIES  # noqa: F401
