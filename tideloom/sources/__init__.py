from .drift import read_drifting
from .files import FORMATS, list_objects, read_batch, read_stream, with_provenance
from .queue_folder import read_messages

__all__ = ["FORMATS", "list_objects", "read_batch", "read_drifting", "read_messages", "read_stream", "with_provenance"]
