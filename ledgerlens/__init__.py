"""ledgerlens: ledger-versus-snapshot inventory reconciliation on Spark.

Every operator is a function from DataFrames (and plain parameters) to a
DataFrame.  Nothing is collected to the driver; configuration such as site
profiles and location lists lives in small dimension DataFrames.
"""

from ledgerlens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
