"""Query plans over the driver tables, and the registry of their names."""

from lintel.plans import relational  # noqa: F401
from lintel.plans import retrieval  # noqa: F401
from lintel.plans import texts  # noqa: F401
from lintel.plans import governance  # noqa: F401
from lintel.plans import sources  # noqa: F401
from lintel.plans import review  # noqa: F401
from lintel.plans import matching  # noqa: F401
from lintel.plans import streams  # noqa: F401
from lintel.plans import kept  # noqa: F401
from lintel.plans import phrased  # noqa: F401
