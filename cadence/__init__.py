"""cadence: listening analytics and playlist recommendations on Spark.

Every public operator takes and returns DataFrames, is lazy, and takes an
explicit ``as_of`` where the result depends on the clock.
"""

from cadence.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
