"""tickloom: order-flow and tick analytics expressed as Spark DataFrame plans."""

from tickloom.order import EventOrder, Frames, number_rows, running, windowed, time_windowed
from tickloom.session import build_session

__all__ = [
    "EventOrder",
    "Frames",
    "build_session",
    "number_rows",
    "running",
    "time_windowed",
    "windowed",
]
