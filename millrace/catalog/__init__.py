"""Registered queries, each with the SQL that states the same result where SQL can."""
from millrace.catalog.base import ORACLES, QUERIES  # noqa: F401
from millrace.catalog import profiles  # noqa: F401, E402
from millrace.catalog import steps  # noqa: F401, E402
from millrace.catalog import ordering  # noqa: F401, E402
from millrace.catalog import relations  # noqa: F401, E402
from millrace.catalog import checks  # noqa: F401, E402
from millrace.catalog import storage  # noqa: F401, E402
from millrace.catalog import exact  # noqa: F401, E402
