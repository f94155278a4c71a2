"""terrastate: DataFrame operators for event-sourced territory maps on Spark.

Click logs become tile ownership by last-writer-wins, change streams and
leaderboards; tiles are assigned to countries by a cell-keyed point-in-polygon
join; ownership is compared between environments; map elements are turned
into cities and roads.  Every operator takes and returns DataFrames.
"""

from terrastate.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
