from .drain import drain_files, drain_messages, drain_receipts
from .receipts import count_receives, once

__all__ = ["count_receives", "drain_files", "drain_messages", "drain_receipts", "once"]
