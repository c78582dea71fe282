"""furlong: a Spark-native batch analytics engine for event-results data."""

from furlong.session import get_session

__all__ = ["get_session"]
