"""One thread for matrix products inside a task; see ``labelloom.threads``."""

from labelloom.threads import SETTERS, one_thread

__all__ = ["SETTERS", "one_thread"]
