"""Import every plan module so its queries register."""

from cadence.plans import playlists  # noqa: F401
from cadence.plans import models  # noqa: F401
from cadence.plans import sync  # noqa: F401
from cadence.plans import model_checks  # noqa: F401
from cadence.plans import playlists as _p2  # noqa: F401
