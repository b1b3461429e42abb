"""Market-bar and news-sentiment feature engine built on PySpark DataFrames."""

from barline.session import build_session, prepare

__all__ = ["build_session", "prepare"]
