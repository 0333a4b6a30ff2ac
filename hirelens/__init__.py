"""Job-posting analytics written as plain PySpark DataFrame functions."""

from hirelens.session import build_session, settle, shared_folder

__all__ = ["build_session", "settle", "shared_folder"]
