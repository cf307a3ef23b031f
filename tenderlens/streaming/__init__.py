"""Incremental ingestion: new feed files become contracts, new contracts refresh the radar.

Award dates are data, not event time: an old award that arrives late simply lands in its own year, so there is
no watermark and nothing is dropped.
"""

from tenderlens.streaming.jobs import stream_contracts, stream_radar

__all__ = ["stream_contracts", "stream_radar"]
