"""Feed and article analytics on Spark DataFrames.

Column functions live in ``feedloom.functions``, readers and writers in
``feedloom.sources``, table operators in ``feedloom.operators``, end-to-end jobs in
``feedloom.plans`` and the Structured Streaming forms in ``feedloom.streaming``.

Every timestamp is ``TIMESTAMP_NTZ`` holding UTC wall-clock time, so results do not
depend on the session time zone, and every "now" is the explicit ``as_of`` argument.
"""

from feedloom.profile import SiteProfile

__all__ = ["SiteProfile"]
