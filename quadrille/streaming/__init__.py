"""Streams of workbooks."""

from quadrille.streaming.workbooks import parse_workbooks, read_cells, stream_cells

__all__ = ["parse_workbooks", "read_cells", "stream_cells"]
